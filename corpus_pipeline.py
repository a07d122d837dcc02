"""A corpus made ready for training: five stages over documents, each written as Parquet and read again by the next."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, minhash, packing, secrets, substring
from quarry.llm.common import ensure_checkpoint_dir

#: Packing and learned models can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

WINDOW, END_ID = 1024, 0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language can be told (null texts, texts without a letter); fills in a missing lang."""
    names = docs.schema.names
    out = langid.predict(docs, *langid.learn(docs)).filter(F.col("lang_pred") != langid.UNKNOWN)
    columns = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred").alias("lang")}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")) for c in names])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group, and one row of a repeated doc_id.

    Rows without a doc_id can't be told apart and stay.
    """
    judged = minhash.near_duplicates(docs, k=5, percent=80)
    kept = judged.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    stay = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter("doc_id IS NULL")).select(*docs.schema.names)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated paragraphs out of all documents but the first that has them."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.schema.names)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.schema.names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most WINDOW tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW, END_ID)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with Parquet between them in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.System.nanoTime()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
