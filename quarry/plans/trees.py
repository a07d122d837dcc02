"""Trees, supersession chains, the hash chain and claims."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans.records import _CHAINED
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql

_UP = "+up(id, ancestor, parent, up) AS (SELECT id, id, parent, 0 FROM nodes UNION ALL SELECT u.id, n.id, n.parent, u.up + 1 FROM up u JOIN nodes n ON n.id = u.parent WHERE u.up < 64) "
VALID_AT, KNOWN_AT = 1_000_000_000_000, 999_000_000_000


@query(sql("nodes links", _UP + "SELECT u.ancestor AS root, count(*) AS n, max(ts) AS last_ts FROM links l JOIN up u ON u.id = l.node WHERE u.parent IS NULL GROUP BY 1", True))
def tree_root_rollup(spark, d):
    nodes = lake.nodes(spark, d)
    roots = nodes.filter("parent IS NULL").select(F.col("id").alias("ancestor"))
    of = graph.closure(spark, nodes).join(roots, "ancestor", "left_semi")
    # counts per node first: the tree is joined with few rows
    per_node = lake.links(spark, d).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return per_node.join(of, "id").groupBy(F.col("ancestor").alias("root")).agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


@query(sql("nodes", _UP + "SELECT depth, count(*) AS n FROM (SELECT id, max(up) AS depth FROM up GROUP BY id) GROUP BY depth", True))
def tree_depth_histogram(spark, d):
    depth = graph.closure(spark, lake.nodes(spark, d)).groupBy("id").agg(F.max("up").alias("depth"))
    return depth.groupBy("depth").agg(F.count("*").alias("n"))


@query(sql("nodes", _UP + "SELECT id, min(ancestor) AS project FROM up WHERE ancestor IN ('n:3', 'r:1') GROUP BY id", True))
def tree_ancestor_project(spark, d):
    up = graph.closure(spark, lake.nodes(spark, d)).filter(F.col("ancestor").isin("n:3", "r:1"))
    return up.groupBy("id").agg(F.min("ancestor").alias("project"))


@query(sql("nodes links", _UP + ", s AS (SELECT u.ancestor AS node, count(l.id) AS n, max(l.ts) AS last_ts FROM up u LEFT JOIN links l ON l.node = u.id GROUP BY 1) SELECT node, n, last_ts, coalesce(hi - last_ts >= 0.34 * (hi - lo), false) AS cold FROM s, (SELECT min(ts) AS lo, max(ts) AS hi FROM links)", True).replace(") , s AS", "), s AS"))
def subtree_coldness(spark, d):
    links = lake.links(spark, d)
    per_node = links.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("k"), F.max("ts").alias("t"))
    rolled = graph.closure(spark, lake.nodes(spark, d)).join(per_node, "id", "left")
    rolled = rolled.groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.max("t").alias("last_ts"))
    span = links.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    cold = F.coalesce(F.col("hi") - F.col("last_ts") >= 0.34 * (F.col("hi") - F.col("lo")), F.lit(False))
    return rolled.crossJoin(F.broadcast(span)).select("node", "n", "last_ts", cold.alias("cold"))


@query("SELECT o_orderkey AS old_seq, last_value(o_orderkey) OVER w AS head, count(*) OVER w - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hops FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY hops > 0")
def supersession_heads(spark, d):
    # orders are renumbered by rank in time, so that each edge goes forward
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = lake.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"))
    seq = (F.col("o_custkey") * lake.TURNS + F.col("r")).alias("seq")
    named = o.select(seq, "o_orderkey")
    edges = o.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).filter("r < n").select(seq.alias("old_seq"), (seq + 1).alias("new_seq"))
    heads = graph.chain_heads(edges)
    out = heads.join(named.select(F.col("seq").alias("old_seq"), F.col("o_orderkey").alias("old_id")), "old_seq")
    out = out.join(named.select(F.col("seq").alias("head"), F.col("o_orderkey").alias("head_id")), "head")
    return out.select(F.col("old_id").alias("old_seq"), F.col("head_id").alias("head"), "hops")


@query(sql("claims", f"SELECT id, subject, value, valid_from, valid_until FROM claims WHERE recorded_at <= {KNOWN_AT} AND valid_from <= {VALID_AT} AND (valid_until IS NULL OR valid_until > {VALID_AT})"))
def claims_asof(spark, d):
    return graph.claims_as_of(lake.claims(spark, d), VALID_AT, KNOWN_AT).select("id", "subject", "value", "valid_from", "valid_until")


@query(sql("claims", f"SELECT subject, count(*) AS n, array_to_string(list_sort(list(DISTINCT value)), ',') AS choices FROM claims WHERE recorded_at <= {KNOWN_AT} GROUP BY subject HAVING count(DISTINCT value) > 1"))
def unresolved_alternatives(spark, d):
    found = graph.alternatives(lake.claims(spark, d).filter(F.col("recorded_at") <= KNOWN_AT))
    return found.select("subject", "n", F.array_join("choices", ",").alias("choices"))


@query("SELECT event_id AS seq, sha256('{\"seq\":' || event_id || ',\"ts\":' || (epoch_us(ts) // 1000) || ',\"kind\":\"' || event_type || '\",\"author\":\"' || user_id || '\",\"payload_hash\":\"' || sha256(props) || '\",\"prev_hash\":null}') AS entry_hash FROM events")
def canonical_event_hash(spark, d):
    rows = lake.ledger(spark, d).withColumn("payload_hash", F.sha2("payload", 256)).withColumn("prev_hash", F.lit(None).cast("string"))
    return rows.select("seq", F.sha2(graph.event_body(), 256).alias("entry_hash"))


@query(sql("ledger", _CHAINED + ", h AS (SELECT *, lag(entry, 1, repeat('0', 64)) OVER (PARTITION BY session ORDER BY i) <> prev AS unlinked FROM c) SELECT CAST(session AS VARCHAR) AS chain, count(*) AS checked, count(*) FILTER (WHERE unlinked) AS n_bad, max_by(entry, i) AS head, count(*) FILTER (WHERE unlinked) = 0 AS ok FROM h GROUP BY session", True))
def chain_verify(spark, d):
    return graph.verify_chain(graph.build_chain(lake.ledger(spark, d), "session")).select("chain", "checked", "n_bad", "head", "ok")


@query("SELECT CAST(user_id AS VARCHAR) AS chain, min(event_id) AS first_bad_seq FROM events WHERE event_id % 1000 = 7 GROUP BY 1")
def chain_tamper_detect(spark, d):
    rows = graph.build_chain(lake.ledger(spark, d), "session")
    rows = rows.withColumn("author", F.when(F.col("seq") % 1000 == 7, "intruder").otherwise(F.col("author")))
    return graph.verify_chain(rows).filter("NOT ok").select("chain", "first_bad_seq")


@query("SELECT 1 AS chains, count(*) AS checked, count(*) FILTER (event_id % 1000 = 7) AS n_bad, 'all' AS first_bad_chain, min(event_id) FILTER (event_id % 1000 = 7) AS first_bad_seq, count(*) FILTER (event_id % 1000 = 7) = 0 AS ok FROM events")
def one_chain_verify(spark, d):
    """All events as one chain, some of them altered after it was made."""
    rows = graph.build_chain(lake.ledger(spark, d).withColumn("all", F.lit("all")), "all")
    rows = rows.withColumn("author", F.when(F.col("seq") % 1000 == 7, "intruder").otherwise(F.col("author")))
    return graph.overall(graph.verify_chain(rows))
