"""A frozen set of probes with known answers, and how well the ranked arms find these."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.search import K1, B, TextIndex

#: Words of a probe taken out of a text, and of one that is a title.
SPAN, TITLE = (8, 12), 8


def words(text: Column) -> Column:
    """Words between white space that have a letter or digit."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def draw(seed: int, subject: str, key: Column) -> Column:
    """What a seed draws for a candidate: 32 hexadecimal digits, the same wherever and whenever it is asked for."""
    return F.md5(F.concat(F.lit(f"{seed}:{subject}:"), key.cast("string")))


def _number(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 7), 16, 10).cast("long")


def spans(rows: DataFrame, subject: str, key: str, text: str, seed: int) -> DataFrame:
    """Candidates (subject, gold, drawn, query): a stretch of each text that has enough words, its length and place drawn."""
    w = rows.select(F.col(key).alias("gold"), words(F.col(text)).alias("w"), draw(seed, subject, F.col(key)).alias("drawn")).filter(F.size("w") >= SPAN[0])
    n = F.least(SPAN[0] + _number(F.col("drawn"), 1) % (SPAN[1] - SPAN[0] + 1), F.size("w"))
    start = _number(F.col("drawn"), 9) % (F.size("w") - n + 1)
    return w.select(F.lit(subject).alias("subject"), "gold", "drawn", F.array_join(F.slice("w", (start + 1).cast("int"), n.cast("int")), " ").alias("query"))


def titles(rows: DataFrame, subject: str, key: str, text: str, seed: int) -> DataFrame:
    """Candidates whose query is the beginning of a title."""
    w = rows.select(F.col(key).alias("gold"), F.slice(words(F.col(text)), 1, TITLE).alias("w"), draw(seed, subject, F.col(key)).alias("drawn")).filter(F.size("w") > 0)
    return w.select(F.lit(subject).alias("subject"), "gold", "drawn", F.array_join("w", " ").alias("query"))


def freeze(candidates: DataFrame, each: int) -> DataFrame:
    """(subject, gold, query): of each subject the candidates with the `each` least draws. Parts of the candidates keep their
    own least before they are brought together, so the set is one of a bottom-k sketch's."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy("drawn", "gold"))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= each).select("subject", "gold", "query")


def asked(query: Column) -> Column:
    """The different terms of a query, stopwords dropped while others stay, of the first MAX_TERMS."""
    found = tx.terms(query)
    content = F.filter(found, lambda t: ~t.isin(tx.STOPWORDS))
    return F.array_distinct(F.slice(F.when(F.size(content) > 0, content).otherwise(found), 1, tx.MAX_TERMS))


def evaluate(index: TextIndex, probes: DataFrame, weights: list[float], depth: int) -> DataFrame:
    """(subject, gold, rank) of probes (subject, gold, query): the place of the gold row among those that BM25 finds, null if it
    isn't found or comes after `depth`. All probes at once: the words asked meet the lists, and a probe's rows are
    counted where they are ahead of its gold row; no probe's rows are gathered."""
    terms = probes.select("subject", "gold", F.explode(asked(F.col("query"))).alias("term"))
    hits = index.tokens.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    tf = sum(w * F.col(f"tf_{c}") for w, c in zip(weights, index.columns))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / index.average))
    scored = hits.join(df, "term").select("term", "key", one.alias("one")).join(terms, "term").groupBy("subject", "gold", "key").agg(F.round(F.sum("one"), 6).alias("score"))
    best = scored.filter(F.col("key") == F.col("gold")).select("subject", "gold", F.col("score").alias("own"))
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("key") <= F.col("gold")))
    ranks = scored.join(best, ["subject", "gold"]).groupBy("subject", "gold").agg(F.count_if(ahead).alias("rank"))
    out = probes.select("subject", "gold").join(ranks, ["subject", "gold"], "left")
    return out.select("subject", "gold", F.when(F.col("rank") <= depth, F.col("rank")).alias("rank"))


def report(ranks: DataFrame) -> DataFrame:
    """(subject, n, hits, recall, mrr)."""
    by = ranks.groupBy("subject").agg(F.count("*").alias("n"), F.count("rank").alias("hits"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return by.select("subject", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
