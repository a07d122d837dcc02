"""Logical frames of the lake over the stored tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import shared_folder
from quarry.operators.search import TextIndex, write_index
from quarry.operators.trigrams import TrigramIndex, write_trigrams

#: Room for a conversation's turns in a sequence number.
TURNS = 100_000
DAY_MS = 86_400_000
#: Characters of a prompt's opening, whose terms weigh more.
HEAD = 400


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(ts: str):
    """Unix milliseconds of a zone-free timestamp."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """(seq, ts, kind, author, session, payload, value): the event ledger."""
    e = table(spark, d, "events")
    author = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"), millis("ts").alias("ts"), F.col("event_type").alias("kind"), author.alias("author"),
        F.col("user_id").alias("session"), F.col("props").alias("payload"), "value",
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(seq, session, turn, role, body): prompts in order of conversation and turn, numbered without a global sort."""
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * TURNS + F.col("turn")).alias("seq"), F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("body"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """(id, body, surface, project, body_hash): the prompt corpus."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("lang").alias("surface"), F.col("source").alias("project"), F.sha2("text", 256).alias("body_hash"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(id, url, title, text, context_hash): page visits with tags stripped."""
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = F.trim(F.regexp_replace("html", "<[^>]*>", " "))
    return p.select(F.col("page_id").alias("id"), "url", title.alias("title"), text.alias("text"), F.sha2("html", 256).alias("context_hash"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, parent, title): regions, their nations and those's customers as a class tree."""
    r = table(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")), "n_name")
    c = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")), "c_name")
    return r.union(n).union(c)


def links(spark: SparkSession, d: str) -> DataFrame:
    """(id, node, ts): the orders filed under their customers."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("node"), millis("o_orderdate").alias("ts"))


def supersessions(spark: SparkSession, d: str) -> DataFrame:
    """(old_seq, new_seq): each order is superseded by its customer's next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("old_seq"), F.lead("o_orderkey").over(w).alias("new_seq"))
    return o.filter("new_seq IS NOT NULL")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """(id, subject, value, valid_from, valid_until, recorded_at), days as milliseconds: a customer's order status over time."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = millis("o_orderdate")
    o = table(spark, d, "orders").withColumn("valid_from", at).withColumn("valid_until", F.lead("valid_from").over(w))
    recorded = F.col("valid_from") + (F.col("o_orderkey") % 30) * DAY_MS
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("value"), "valid_from", "valid_until", recorded.alias("recorded_at"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, node, v): embeddings as array<double> under their class."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("node"), F.col("embedding").cast("array<double>").alias("v"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(id, target, text, starred, updated): parts stand in for annotations of events."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_partkey") * 3).alias("target"), F.concat_ws(" ", "p_name", "p_type").alias("text"),
        (F.col("p_size") > 40).alias("starred"), (F.col("p_size") * 1000 + F.col("p_partkey") % 7).alias("updated"),
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The turns as prompts with the columns that facets and scopes read; what the table lacks is derived from the conversation's number."""
    c, t = F.col("session"), turns(spark, d)
    name = lambda prefix, m: F.concat(F.lit(prefix), (c % m).cast("string"))
    return t.select(
        "seq", "session", "turn", "role", "body", (F.col("seq") * 1000 + 1704067200000).alias("ts"), name("m", 5).alias("mission"),
        F.element_at(F.array(*map(F.lit, ("cli", "web", "api"))), (c % 3 + 1).cast("int")).alias("surface"), F.when(c % 2 == 0, "chat").otherwise("review").alias("thread_kind"),
        name("t", 11).alias("thread"), F.when(c % 4 != 0, c - c % 4).alias("parent"), name("p", 6).alias("project"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("model-"), (F.col("turn") % 2).cast("string"))).alias("model"), name("c:", 50).alias("principal"),
        name("d", 9).alias("device"), F.when(F.col("role") == "assistant", name("a", 3)).alias("agent"), F.when(c % 3 != 0, name("r", 8)).alias("run"), name("o", 2).alias("org"),
    )


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """(kind, target, chunk, model, v): the vector index; one of five vectors is of an older model, and five are one target's chunks."""
    e = table(spark, d, "embeddings")
    kind = F.when(F.col("label") % 2 == 0, "prompt").otherwise("browse_event").alias("kind")
    model = F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("model")
    return e.select(kind, F.floor(F.col("vec_id") / 5).cast("long").alias("target"), (F.col("vec_id") % 5).cast("int").alias("chunk"), model, F.col("embedding").cast("array<double>").alias("v"))


def _index(spark: SparkSession, d: str, name: str, build, kind: str = "terms"):
    """An index of one snapshot of a table, written once a session into the shared folder; a newer snapshot's takes its place."""
    files = tuple(sorted(table(spark, d, name).inputFiles()))
    known = spark.sparkContext.__dict__.setdefault("_quarry_indexes", {})
    if known.get((kind, name, d), (None,))[0] != files:
        known[kind, name, d] = files, build(f"{shared_folder(spark)}/index-{kind}-{name}-{uuid.uuid4().hex}")
    return known[kind, name, d][1]


def prompt_index(spark: SparkSession, d: str) -> TextIndex:
    """Prompts' terms, in the opening lines (head) and after them (tail)."""
    opening = {"head": F.substring("body", 1, HEAD), "tail": F.substring("body", HEAD + 1, 1 << 30)}
    return _index(spark, d, "documents", lambda folder: write_index(prompts(spark, d), "id", opening, folder))


def page_index(spark: SparkSession, d: str) -> TextIndex:
    parts = {c: F.col(c) for c in ("title", "url", "text")}
    return _index(spark, d, "pages", lambda folder: write_index(pages(spark, d), "id", parts, folder))


def asked_index(spark: SparkSession, d: str) -> TextIndex:
    return _index(spark, d, "conversations", lambda folder: write_index(asked(spark, d), "seq", {"body": F.col("body")}, folder))


def note_index(spark: SparkSession, d: str) -> TextIndex:
    return _index(spark, d, "part", lambda folder: write_index(notes(spark, d), "id", {"text": F.col("text")}, folder))


def node_index(spark: SparkSession, d: str) -> TextIndex:
    return _index(spark, d, "customer", lambda folder: write_index(nodes(spark, d), "id", {"title": F.col("title")}, folder))


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """The vector index, written once a session with a folder for each model: a scan of one model reads no other's files."""

    def write(folder):
        indexed(spark, d).repartition("model").write.partitionBy("model").parquet(folder)
        return spark.read.parquet(folder)

    return _index(spark, d, "embeddings", write, "vectors")


def prompt_grams(spark: SparkSession, d: str) -> TrigramIndex:
    return _index(spark, d, "documents", lambda folder: write_trigrams(prompts(spark, d), "id", {"body": F.col("body")}, folder), "grams")


def page_grams(spark: SparkSession, d: str) -> TrigramIndex:
    """Addresses and titles of pages; what stands in a page is found by its terms."""
    return _index(spark, d, "pages", lambda folder: write_trigrams(pages(spark, d), "id", {"url": F.col("url"), "title": F.col("title")}, folder), "grams")


#: The same frames as DuckDB common table expressions.
CTE = {
    "ledger": "ledger AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type AS kind, CAST(user_id AS VARCHAR) AS author, user_id AS session, props AS payload, value FROM events)",
    "turns": "turns AS (SELECT conv_id * 100000 + turn AS seq, conv_id AS session, turn, role, text AS body FROM conversations)",
    "prompts": "prompts AS (SELECT doc_id AS id, text AS body, lang AS surface, source AS project, sha256(text) AS body_hash FROM documents)",
    "pagev": "pagev AS (SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS text, sha256(html) AS context_hash FROM pages)",
    "nodes": "nodes AS (SELECT 'r:' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, c_name FROM customer)",
    "links": "links AS (SELECT o_orderkey AS id, 'c:' || o_custkey AS node, (epoch_us(o_orderdate) // 1000) AS ts FROM orders)",
    "sup": "sup AS (SELECT * FROM (SELECT o_orderkey AS old_seq, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new_seq FROM orders) WHERE new_seq IS NOT NULL)",
    "claims": "claims AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderstatus AS value, (epoch_us(o_orderdate) // 1000) AS valid_from, lead((epoch_us(o_orderdate) // 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until, (epoch_us(o_orderdate) // 1000) + (o_orderkey % 30) * 86400000 AS recorded_at FROM orders)",
    "notes": "notes AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN p_partkey * 3 END AS target, p_name || ' ' || p_type AS text, p_size > 40 AS starred, p_size * 1000 + p_partkey % 7 AS updated FROM part)",
    "asked": "asked AS (SELECT conv_id * 100000 + turn AS seq, conv_id AS session, turn, role, text AS body, (conv_id * 100000 + turn) * 1000 + 1704067200000 AS ts, 'm' || conv_id % 5 AS mission, ['cli', 'web', 'api'][conv_id % 3 + 1] AS surface, CASE WHEN conv_id % 2 = 0 THEN 'chat' ELSE 'review' END AS thread_kind, 't' || conv_id % 11 AS thread, CASE WHEN conv_id % 4 <> 0 THEN conv_id - conv_id % 4 END AS parent, 'p' || conv_id % 6 AS project, CASE WHEN role = 'assistant' THEN 'model-' || turn % 2 END AS model, 'c:' || conv_id % 50 AS principal, 'd' || conv_id % 9 AS device, CASE WHEN role = 'assistant' THEN 'a' || conv_id % 3 END AS agent, CASE WHEN conv_id % 3 <> 0 THEN 'r' || conv_id % 8 END AS run, 'o' || conv_id % 2 AS org FROM conversations)",
    "indexed": "indexed AS (SELECT CASE WHEN label % 2 = 0 THEN 'prompt' ELSE 'browse_event' END AS kind, vec_id // 5 AS target, vec_id % 5 AS chunk, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS model, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "vecs": "vecs AS (SELECT vec_id AS id, label AS node, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """WITH the named frames, body."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(CTE[n] for n in names.split()) + (", " if body.startswith("+") else " ") + body.lstrip("+")
