"""Streaming operators run to the end of their input, next to the same rows in SQL."""

import uuid

from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.operators import graph
from quarry.operators.lineage import cut, shared_folder
from quarry.plans.vectors import centroids
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql
from quarry.streaming import stateful, streams


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, count(*) AS n FROM (SELECT event_id, user_id FROM events UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 5 = 0) GROUP BY event_id, user_id")
def stream_dedup(spark, d):
    """Every third event comes again within the time to live and is dropped; every fifth comes again long after, in a second
    run over the same checkpoint, and counts anew."""
    base = _folder(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id")
    soon = e.filter("event_id % 3 = 0").withColumn("ts", F.expr("ts + INTERVAL 60 SECONDS"))
    # an event far ahead moves the watermark past all others
    ahead = e.agg(F.expr("max(ts) + INTERVAL 30 DAYS").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"))
    late = e.filter("event_id % 5 = 0").withColumn("ts", F.expr("ts + INTERVAL 90 DAYS"))
    for batch in (e.union(soon).union(ahead), late):
        batch.write.mode("append").parquet(f"{base}/in")
        stream = streams.dedup_events(streams.event_stream(spark, f"{base}/in"))
        streams.run_available(stream.select("event_id", "user_id"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").filter("event_id >= 0").groupBy("event_id", "user_id").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session_counts(spark, d):
    """Session windows, written once the watermark has passed their end: state is kept for open ones only."""
    base = _folder(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    # an event far ahead moves the watermark past the last session
    end = events.agg(F.expr("max(ts) + INTERVAL 30 DAYS").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"))
    end.write.mode("append").parquet(f"{base}/in")
    counted = streams.session_counts(streams.event_stream(spark, f"{base}/in"))
    flat = counted.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    streams.run_available(flat, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").filter("user_id >= 0")


@query("SELECT doc_id AS id, n_chars AS chars FROM documents WHERE text IS NOT NULL AND doc_id >= 0")
def stream_index(spark, d):
    """A continuous index: each batch of new texts is embedded and appended; two runs over one checkpoint do every text once."""
    base = _folder(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    docs.filter("doc_id % 2 = 0").write.parquet(f"{base}/in")

    def tick(batch, number):
        v = vector.hashed_embedding(F.col("text"), 64)
        batch.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"), v.alias("v")).write.mode("append").parquet(f"{base}/index")

    for _ in range(2):
        stream = streams.event_stream(spark, f"{base}/in")
        stream.writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        docs.filter("doc_id % 2 <> 0").write.mode("overwrite").parquet(f"{base}/more")
        spark.read.parquet(f"{base}/more").filter(F.lit(_ == 0)).write.mode("append").parquet(f"{base}/in")
    return spark.read.parquet(f"{base}/index").filter(F.size("v") == 64).select("id", "chars")


def _thirds(rows, order: str):
    """Rows in three parts by their number, in its order."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    a, b = low + (high - low) // 3, low + 2 * (high - low) // 3
    return [rows.filter(F.col(order) <= a), rows.filter((F.col(order) > a) & (F.col(order) <= b)), rows.filter(F.col(order) > b)]


def _by_batches(spark, frames, base: str, made, mode: str):
    """Runs the stream made of the frames, one at a time, over one checkpoint; rows of all batches."""
    streams.in_steps(frames, f"{base}/in")
    with stateful.state_store(spark):
        out = made(streams.event_stream(spark, f"{base}/in", 1)).writeStream.outputMode(mode)
        out.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(sql("ledger", "SELECT CAST(session AS VARCHAR) AS chain, count(*) AS checked, count(*) FILTER (WHERE seq % 1000 = 7) AS n_bad, min(seq) FILTER (WHERE seq % 1000 = 7) AS first_bad_seq FROM ledger GROUP BY session"))
def stream_chain_verify(spark, d):
    """Chains that grow from batch to batch, checked as they come against the hash kept of each; some rows were altered."""
    rows = graph.build_chain(lake.ledger(spark, d), "session").withColumn("author", F.when(F.col("seq") % 1000 == 7, "intruder").otherwise(F.col("author")))
    verdicts = _by_batches(spark, _thirds(cut(rows), "seq"), _folder(spark), stateful.verified, "append")
    return verdicts.groupBy("chain").agg(F.sum("checked").alias("checked"), F.sum("n_bad").alias("n_bad"), F.min("first_bad_seq").alias("first_bad_seq"))


@query(sql("ledger", "+r AS (SELECT kind AS op, CAST(floor(value) AS BIGINT) AS ms, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY kind) AS n FROM ledger) SELECT op, max(n) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY ms) AS p95, max(ms) AS max FROM r WHERE r <= 256 GROUP BY op"))
def stream_latency_ring(spark, d):
    """Percentiles of each operation's newest samples, brought up to date by every batch; the last word on each."""
    samples = lake.ledger(spark, d).select(F.col("kind").alias("op"), "seq", F.floor("value").alias("ms"))
    rows = _by_batches(spark, _thirds(samples, "seq"), _folder(spark), stateful.latencies, "update")
    last = rows.groupBy("op").agg(F.max_by(F.struct("n", "p50", "p95", "max"), "batch").alias("r"))
    return last.select("op", "r.n", "r.p50", "r.p95", "r.max")


LEAST, MARGIN = 0.1, 0.02
_UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


@query("WITH RECURSIVE u AS (SELECT vec_id AS seq, label % 2 AS root, label AS node, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), w AS (SELECT *, " + _UNIT + " AS unit FROM u), p AS (SELECT root, node, i, sum(unit[i]) AS s FROM w, range(1, 65) r(i) WHERE seq % 2 = 0 GROUP BY ALL), c AS (SELECT root, node, list(s ORDER BY i) AS total FROM p GROUP BY ALL), "
       "start AS (SELECT root, list(node ORDER BY node) AS names, list(total ORDER BY node) AS totals FROM c GROUP BY root), items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS i FROM w WHERE seq % 2 = 1), "
       "steps AS (SELECT root, 0::BIGINT AS i, names, totals, NULL::BIGINT AS seq, NULL::INT AS node, NULL::DOUBLE AS score, NULL::DOUBLE AS margin FROM start UNION ALL "
       "SELECT root, i, names, CASE WHEN ok THEN list_transform(totals, lambda t, j: CASE WHEN j = best THEN list_transform(list_zip(t, unit), lambda z: z[1] + z[2]) ELSE t END) ELSE totals END, seq, CASE WHEN ok THEN names[best] END, sims[best], margin FROM "
       f"(SELECT *, sims[best] >= {LEAST} AND margin >= {MARGIN} AS ok FROM (SELECT *, list_position(sims, list_max(sims)) AS best, round(list_reverse_sort(sims)[1] - list_reverse_sort(sims)[2], 9) AS margin FROM (SELECT s.root, x.i, s.names, s.totals, x.seq, x.unit, list_transform(s.totals, lambda t: round(list_cosine_similarity(t, x.v), 9)) AS sims FROM steps s JOIN items x ON x.root = s.root AND x.i = s.i + 1)))) "
       "SELECT seq, root, node, round(score, 6) AS score, round(margin, 6) AS margin FROM steps WHERE i > 0")  # fmt: skip
def stream_filing(spark, d):
    """Every other vector is filed already; the rest comes in batches and moves the centroids it is filed under."""
    v = lake.vectors(spark, d).select(F.col("id").alias("seq"), (F.col("node") % 2).cast("long").alias("root"), F.col("node").cast("long").alias("node"), "v")
    members = v.filter("seq % 2 = 0").select("root", "node", vector.unit("v").alias("v"))
    first = centroids(members).join(members.select("root", "node").distinct(), "node").select("root", "node", "n", F.col("c").alias("total"))
    items = v.filter("seq % 2 = 1").select("seq", "root", "v")
    out = _by_batches(spark, _thirds(items, "seq"), _folder(spark), lambda s: stateful.filed(s, first, LEAST, MARGIN), "append")
    return out.select("seq", "root", "node", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(sql("ledger turns pagev notes", "SELECT l.seq, l.kind, coalesce(t.role, CASE WHEN g.id IS NOT NULL THEN 'page' WHEN n.text IS NOT NULL THEN 'note' END) AS role, CASE WHEN length(b.body) > 4000 THEN substr(b.body, 1, 4000) || '…' ELSE b.body END AS body FROM ledger l LEFT JOIN turns t ON t.session = l.session AND t.turn = l.seq % 8 LEFT JOIN pagev g ON g.id = l.seq LEFT JOIN notes n ON n.target = l.seq AND n.target % 90 <= 60, LATERAL (SELECT coalesce(t.body, g.text, n.text) AS body) b WHERE l.kind NOT IN ('view', 'signup') AND coalesce(t.role, '') <> 'assistant'"))
def stream_delta(spark, d):
    """The delta as a stream: prompts and pages are joined from tables, notes from a second stream within an hour of their event;
    later ones count no more."""
    base = _folder(spark)
    at = F.timestamp_millis("ts")
    events = lake.ledger(spark, d).select("seq", at.alias("at"), "kind", "session", (F.col("seq") % 8).cast("int").alias("turn"))
    # an event and a note far ahead move both watermarks past all others
    end = events.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("seq"), "at", F.lit("click").alias("kind"), F.lit(-1).cast("long").alias("session"), F.lit(-1).alias("turn"))
    all_events = streams.at_once([events, end], f"{base}/events")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("target") % 90).cast("int"))
    noted = lake.notes(spark, d).filter("target IS NOT NULL").join(events.select(F.col("seq").alias("target"), "at"), "target")
    noted = noted.select("target", (F.col("at") + minutes).alias("noted_at"), F.col("text").alias("note"))
    last = end.select(F.col("seq").alias("target"), (F.col("at") + F.expr("INTERVAL 2 DAYS")).alias("noted_at"), F.lit("").alias("note"))
    all_notes = streams.at_once([noted, last], f"{base}/notes")
    said = lake.turns(spark, d).select("session", F.col("turn").cast("int").alias("turn"), "role", F.col("body").alias("said"))
    seen = lake.pages(spark, d).select(F.col("id").alias("seq"), F.col("text").alias("page"))
    made = streams.delta(streams.event_stream(spark, f"{base}/events", all_events), said, seen, streams.event_stream(spark, f"{base}/notes", all_notes))
    streams.run_available(made, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").filter("seq >= 0")
