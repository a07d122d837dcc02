"""Relational reads: filters, counts, joins and windows over the lake."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import relational as op
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql


@query(sql("ledger", "SELECT seq, ts, kind, author, CASE WHEN length(payload) > 240 THEN substr(payload, 1, 240) || '…' ELSE payload END AS preview, length(payload) AS chars FROM ledger WHERE kind IN ('click', 'purchase') AND seq < 9000 AND ts >= 1704153600000 ORDER BY seq DESC LIMIT 200"))
def lake_timeline(spark, d):
    page = op.timeline(lake.ledger(spark, d), kinds=["click", "purchase"], after=1704153600000, before_seq=9000, limit=200)
    return page.select("seq", "ts", "kind", "author", op.clip(F.col("payload"), 240).alias("preview"), F.length("payload").alias("chars"))


@query(sql("turns", "SELECT seq, session, role, CASE WHEN length(body) > 240 THEN substr(body, 1, 240) || '…' ELSE body END AS preview FROM turns WHERE role <> 'assistant' AND seq > 500000 ORDER BY seq LIMIT 200"))
def lake_facets(spark, d):
    return op.facet_filter(lake.turns(spark, d), since_seq=500000).select("seq", "session", "role", op.clip(F.col("body"), 240).alias("preview"))


@query(sql("ledger", "SELECT seq, kind FROM ledger WHERE seq > 1000 ORDER BY seq LIMIT 51"))
def lake_cursor_page(spark, d):
    return lake.ledger(spark, d).filter("seq > 1000").orderBy("seq").limit(51).select("seq", "kind")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def counts_by_day(spark, d):
    return lake.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(sql("ledger", "SELECT kind, count(*) AS n FROM ledger GROUP BY 1"))
def counts_by_kind(spark, d):
    return lake.ledger(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(sql("ledger", "SELECT author, count(*) AS n FROM ledger GROUP BY 1"))
def counts_by_author(spark, d):
    return lake.ledger(spark, d).groupBy("author").agg(F.count("*").alias("n"))


@query(sql("prompts", "SELECT surface, count(*) AS n FROM prompts GROUP BY 1"))
def counts_by_surface(spark, d):
    return lake.prompts(spark, d).groupBy("surface").agg(F.count("*").alias("n"))


@query(sql("ledger", "SELECT kind, count(*) AS n FROM ledger WHERE seq > 500 GROUP BY 1 ORDER BY n DESC, kind"))
def delta_summary(spark, d):
    return lake.ledger(spark, d).filter("seq > 500").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query(sql("ledger", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, max_by(payload, seq) AS head FROM ledger"))
def lake_envelope(spark, d):
    return lake.ledger(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("payload", "seq").alias("head"))


@query("SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(author) = 0 THEN 'author' ELSE 'all' END AS facet, coalesce(day, kind, author, '') AS key, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, CAST(user_id AS VARCHAR) AS author FROM events WHERE event_id > 100) GROUP BY GROUPING SETS ((day), (kind), (author), ())")
def stats_grouping_sets(spark, d):
    base = lake.table(spark, d, "events").filter("event_id > 100")
    base = base.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("author"))
    return spark.sql(
        "SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(author) = 0 THEN 'author' ELSE 'all' END AS facet,"
        " coalesce(day, kind, author, '') AS key, count(*) AS n FROM {base} GROUP BY GROUPING SETS ((day), (kind), (author), ())",
        base=base,
    )


@query("WITH r AS (SELECT lang AS surface, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT surface, max(n) AS n, min(n_chars) FILTER (WHERE i >= floor((n - 1) * 0.5 + 0.5)) AS p50, min(n_chars) FILTER (WHERE i >= floor((n - 1) * 0.9 + 0.5)) AS p90 FROM r GROUP BY surface")
def length_quantiles(spark, d):
    rows = lake.table(spark, d, "documents").select(F.col("lang").alias("surface"), "n_chars")
    return op.pick_quantiles(rows, "surface", "n_chars", {"p50": 0.5, "p90": 0.9})


@query("WITH ring AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events), s AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS i, count(*) OVER (PARTITION BY kind) AS n FROM ring WHERE r <= 256) SELECT kind, max(n) AS n, min(value) FILTER (WHERE i >= ceil(0.5 * n)) AS p50, min(value) FILTER (WHERE i >= ceil(0.95 * n)) AS p95 FROM s GROUP BY kind")
def nearest_rank_latency(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("event_id"))
    ring = lake.table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 256")
    return ring.groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95")
    )


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events")
def dist_summary(spark, d):
    e = lake.table(spark, d, "events").select(F.lit(1).alias("all"), "value")
    sums = e.groupBy("all").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    return op.nearest_ranks(e, "all", "value", {"p50": 0.5, "p95": 0.95}).join(sums, "all").select("n", "mean", "p50", "p95", "max")


@query("SELECT role, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE length(text) > 400) AS n_long FROM conversations GROUP BY role")
def corpus_composition(spark, d):
    c = lake.table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.length("text") > 400).alias("n_long"))


@query(sql("prompts", "SELECT project, count(DISTINCT body_hash) AS distinct_bodies, count(*) AS n FROM prompts GROUP BY project"))
def distinct_counts(spark, d):
    return lake.prompts(spark, d).groupBy("project").agg(F.countDistinct("body_hash").alias("distinct_bodies"), F.count("*").alias("n"))


@query(sql("prompts", "SELECT body_hash, min(id) AS id, count(*) AS n FROM prompts GROUP BY body_hash"))
def representative_per_hash(spark, d):
    return lake.prompts(spark, d).groupBy("body_hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER w AS r, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM p")
def consecutive_dedup(spark, d):
    return op.drop_repeats_in_a_row(lake.table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@query(sql("prompts", "+r AS (SELECT *, CASE WHEN surface <> 'en' THEN project END AS run FROM prompts), t AS (SELECT DISTINCT body_hash, project AS run FROM prompts WHERE id % 4 = 0 AND surface <> 'en') SELECT id FROM r WHERE run IS NULL UNION ALL SELECT min(id) FROM r WHERE run IS NOT NULL AND (body_hash, run) NOT IN (SELECT (body_hash, run) FROM t) GROUP BY body_hash, run"))
def insert_dedup(spark, d):
    """Rows of no run all go in; of a run, the first of equal ones, and none that the target has already."""
    rows = lake.prompts(spark, d).withColumn("run", F.when(F.col("surface") != "en", F.col("project")))
    rows = rows.select("id", "body_hash", "run").union(rows.filter("run IS NULL").limit(0).select("id", "body_hash", "run"))
    target = lake.prompts(spark, d).filter("id % 4 = 0 AND surface <> 'en'").select("body_hash", F.col("project").alias("run"))
    return op.insert_new(rows, target, ["body_hash"], "run", "id").select("id")


@query("SELECT l_partkey AS target, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS node FROM lineitem GROUP BY 1")
def first_link_per_target(spark, d):
    li = lake.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("target")).agg(F.min_by("l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def backlog_anti(spark, d):
    docs = lake.table(spark, d, "documents").select("doc_id")
    indexed = lake.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    forgotten = lake.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return docs.join(indexed, "doc_id", "left_anti").join(forgotten, "doc_id", "left_anti")


@query("SELECT event_id, event_type FROM events WHERE user_id IN (SELECT conv_id FROM conversations WHERE role = 'system') OR user_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def scope_semi(spark, d):
    seen = lake.table(spark, d, "conversations").filter("role = 'system'").select(F.col("conv_id").alias("user_id"))
    seen = seen.union(lake.table(spark, d, "documents").filter("source = 'src3'").select("doc_id")).distinct()
    return lake.table(spark, d, "events").join(seen, "user_id", "left_semi").select("event_id", "event_type")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def principal_scope(spark, d):
    people = lake.nodes(spark, d).select("id", "parent")
    return op.principal_closure(people, "r:1").filter("id LIKE 'c:%'").select(F.substring("id", 3, 20).cast("long").alias("id"))


@query(sql("turns", "SELECT seq, session, lag(seq) OVER w AS previous, lead(seq) OVER w AS next FROM turns WINDOW w AS (PARTITION BY session ORDER BY seq)"))
def neighbor_turns(spark, d):
    w = Window.partitionBy("session").orderBy("seq")
    return lake.turns(spark, d).select("seq", "session", F.lag("seq").over(w).alias("previous"), F.lead("seq").over(w).alias("next"))


@query("WITH f AS (SELECT DISTINCT l_orderkey AS session, l_suppkey AS node FROM lineitem) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM f x JOIN f y USING (session) WHERE x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccurrence(spark, d):
    filed = lake.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("node"))
    return op.co_occurrence(filed, 2)


@query(sql("turns", "SELECT thread, count(*) AS n, max(seq) AS last FROM (SELECT 's' || session AS thread, seq FROM turns UNION ALL SELECT role, seq FROM turns) GROUP BY thread"))
def thread_digests(spark, d):
    t = lake.turns(spark, d)
    both = t.select(F.concat(F.lit("s"), F.col("session").cast("string")).alias("thread"), "seq").unionAll(t.select("role", "seq"))
    return both.groupBy("thread").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("SELECT user_id AS session FROM events UNION SELECT conv_id FROM conversations")
def session_union(spark, d):
    return lake.table(spark, d, "events").select(F.col("user_id").alias("session")).union(lake.table(spark, d, "conversations").select("conv_id")).distinct()


@query(sql("turns", "SELECT seq, session, spent FROM (SELECT *, sum(120 + strlen(body)) OVER (PARTITION BY session ORDER BY seq DESC) AS spent, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS place FROM turns) WHERE spent <= 2000 OR place = 1"))
def tail_budget(spark, d):
    cost = F.octet_length("body") + 120
    return op.within_budget(lake.turns(spark, d), "session", [F.desc("seq")], cost, 2000).select("seq", "session", "spent")


@query(sql("turns", "SELECT session, unit, count(*) AS n, min(seq) AS first FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS unit FROM turns) GROUP BY session, unit"))
def turn_groups(spark, d):
    unit = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("session").orderBy("seq"))
    return lake.turns(spark, d).withColumn("unit", unit).groupBy("session", "unit").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


# The decision kinds that are filed.
DECISIONS = ("decision", "resolution", "approval", "reopen", "review_verdict", "pin", "source_trust")
_KINDS = "CASE kind WHEN 'click' THEN 'prompt' WHEN 'signup' THEN 'note' WHEN 'purchase' THEN 'approval' WHEN 'error' THEN 'revision' ELSE 'visit' END"


@query(sql("ledger", f"+k AS (SELECT seq, author, payload, {_KINDS} AS kind, CASE WHEN kind = 'view' THEN 'browse_event' END AS ref FROM ledger) SELECT seq, kind IN ('prompt', 'note', 'approval') OR coalesce(ref = 'browse_event', false) AS fileable, CASE WHEN kind = 'prompt' THEN 'prompt' WHEN ref = 'browse_event' THEN 'browse_event' WHEN kind IN ('note', 'revision') THEN kind ELSE 'decision' END AS target_kind, TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM k WHERE regexp_matches(author, '^[0-9]')"))
def case_mappings(spark, d):
    """What can be filed and as what; event types stand in for kinds."""
    names = {"click": "prompt", "signup": "note", "purchase": "approval", "error": "revision", "view": "visit"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("kind"))
    rows = lake.ledger(spark, d).filter(F.col("author").rlike("^[0-9]")).withColumn("ref", F.when(F.col("kind") == "view", "browse_event")).withColumn("kind", kind)
    page = F.coalesce(F.col("ref") == "browse_event", F.lit(False))
    fileable = F.col("kind").isin("prompt", "note", *DECISIONS) | page
    target = F.when(F.col("kind") == "prompt", "prompt").when(page, "browse_event").when(F.col("kind").isin("note", "revision"), F.col("kind")).otherwise("decision")
    return rows.select("seq", fileable.alias("fileable"), target.alias("target_kind"), F.get_json_object("payload", "$.k").try_cast("long").alias("k"))


@query(sql("ledger", "SELECT seq, key, value FROM (SELECT seq, unnest(json_keys(payload)) AS key, payload FROM ledger WHERE json_valid(payload)), LATERAL (SELECT json_extract_string(payload, key) AS value)"))
def json_entries(spark, d):
    """The entries of stored JSON objects; what isn't JSON has none."""
    entries = F.explode(F.map_entries(F.from_json("payload", "map<string,string>")))
    return lake.ledger(spark, d).select("seq", entries.alias("e")).select("seq", "e.key", "e.value")
