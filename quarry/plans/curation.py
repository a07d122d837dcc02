"""Claims, the class tree's views and its maintenance, filing, recall."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import vector as vx
from quarry.operators import curation as cur
from quarry.operators import graph, intervals, search, simhash
from quarry.operators import relational as op
from quarry.plans.texts import _bm25_sql, _terms_sql
from quarry.plans.trees import KNOWN_AT, VALID_AT
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import DAY_MS, sql

_CLAIMS = "+cl AS (SELECT id, subject, 'status' || id % 2 AS predicate, 'o' || subject % 3 AS scope, value, valid_from, valid_until, recorded_at, CASE WHEN id % 9 = 4 THEN recorded_at + 3456000000 END AS retired_at, CASE WHEN id % 5 = 2 THEN [lag(id) OVER (PARTITION BY subject ORDER BY valid_from, id)] ELSE [] END AS supersedes FROM claims) "


def claim_rows(spark, d):
    """Claims with predicate, scope, retirement, and some that replace their subject's claim before."""
    w = Window.partitionBy("subject").orderBy("valid_from", "id")
    c = lake.claims(spark, d).withColumn("before", F.lag("id").over(w))
    retired = F.when(F.col("id") % 9 == 4, F.col("recorded_at") + 40 * DAY_MS)
    replaces = F.when((F.col("id") % 5 == 2) & F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast("array<long>"))
    return c.select(
        "id", "subject", F.concat(F.lit("status"), (F.col("id") % 2).cast("string")).alias("predicate"), F.concat(F.lit("o"), (F.col("subject") % 3).cast("string")).alias("scope"),
        "value", "valid_from", "valid_until", "recorded_at", retired.alias("retired_at"), replaces.alias("supersedes"),
    )


_CURRENT = _CLAIMS + f", known AS (SELECT * FROM cl WHERE recorded_at <= {KNOWN_AT} AND valid_from <= {VALID_AT} AND (retired_at IS NULL OR retired_at > {KNOWN_AT})), cur AS (SELECT * FROM known k WHERE (valid_until IS NULL OR valid_until > {VALID_AT - 200 * DAY_MS}) AND NOT EXISTS (SELECT 1 FROM known o WHERE list_contains(o.supersedes, k.id))) "


@query(sql("claims", _CURRENT.replace(str(VALID_AT - 200 * DAY_MS), str(VALID_AT)) + "SELECT id, subject, predicate, scope, value, (SELECT array_to_string(list_sort(list(o.id)), ',') FROM cur o WHERE o.subject = c.subject AND o.predicate = c.predicate AND o.scope = c.scope AND o.value <> c.value) AS alternatives, 1 AS found FROM cur c WHERE contains(lower(subject || ' ' || predicate || ' ' || value), 'status1') ORDER BY found DESC, recorded_at DESC, id LIMIT 200"))
def claims_query(spark, d):
    found = cur.current_claims(claim_rows(spark, d), VALID_AT, KNOWN_AT, ["status1"], 500)
    none = F.when(F.size("alternatives") > 0, F.array_join("alternatives", ","))
    return found.select("id", "subject", "predicate", "scope", "value", none.alias("alternatives"), F.col("found").cast("int").alias("found"))


@query(sql("claims", _CLAIMS + f", probes AS (SELECT DISTINCT subject, recorded_at AS at FROM cl) SELECT p.subject, p.at, c.id, c.value FROM probes p JOIN cl c ON c.subject = p.subject AND c.recorded_at <= p.at AND c.valid_from <= p.at AND (c.valid_until IS NULL OR c.valid_until > p.at) AND (c.retired_at IS NULL OR c.retired_at > p.at)"))
def bitemporal_asof(spark, d):
    """Every subject's claims as they were known and valid at each time at which one was recorded."""
    c = claim_rows(spark, d)
    probes = c.select("subject", F.col("recorded_at").alias("at")).distinct()
    known = c.select("subject", "id", "value", F.when(F.col("recorded_at").isNotNull() & F.col("valid_from").isNotNull(), F.greatest("recorded_at", "valid_from")).alias("begins"), F.least("valid_until", "retired_at").alias("ends"))
    return intervals.stab(probes, known, ["subject"], "at", "begins", "ends", 16 * DAY_MS).select("subject", "at", "id", "value")


@query(sql("claims", _CLAIMS + ", f AS (SELECT id, value, recorded_at, CASE WHEN id % 9 = 4 THEN recorded_at + 3456000000 END AS retired_at FROM cl WHERE subject % 7 <> 3) SELECT * FROM f"))
def claim_projection(spark, d):
    """The projection from a log of claims and retirements, some of them twice, without a forgotten source's."""
    c = claim_rows(spark, d)
    made = c.select("id", F.lit("claim").alias("kind"), F.col("recorded_at").alias("ts"), "value", F.col("subject").alias("source"))
    end = c.filter("retired_at IS NOT NULL").select("id", F.lit("claim_retired").alias("kind"), F.col("retired_at").alias("ts"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("source"))
    log = made.union(end).union(end.withColumn("ts", F.col("ts") + 5)).union(end.withColumn("ts", F.lit(0).cast("long")))
    return cur.claim_projection(log, c.select(F.col("subject").alias("source")).filter("source % 7 = 3").distinct())


@query(sql("claims turns", "+v AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'interval' WHEN id % 13 = 0 THEN 'empty' END AS a, CASE WHEN id % 17 = 0 THEN 'uncited' WHEN id % 6 = 0 THEN 'unavailable' WHEN id % 7 = 0 THEN 'role' END AS b, CASE WHEN id % 17 <> 0 AND id % 6 <> 0 AND id % 5 = 0 THEN 'unsupported' END AS c FROM claims) SELECT id, violation FROM (SELECT id, a AS violation FROM v WHERE id % 11 = 0 AND id % 13 <> 0 UNION ALL SELECT id, 'empty' FROM v WHERE id % 13 = 0 UNION ALL SELECT id, 'interval' FROM v WHERE id % 11 = 0 AND id % 13 = 0 UNION ALL SELECT id, b FROM v WHERE b IS NOT NULL UNION ALL SELECT id, c FROM v WHERE c IS NOT NULL)"))
def claim_violations(spark, d):
    """Claims each of whose rules is broken by some."""
    n = F.col("id")
    base = lake.claims(spark, d).select(n, F.col("subject").cast("string").alias("subject"), "value", "valid_from", "recorded_at")
    writes = base.select(
        n, "subject", F.lit("p").alias("predicate"), F.lit("s").alias("scope"), F.when(n % 13 == 0, "").otherwise(F.col("value")).alias("value"), "valid_from",
        F.when(n % 11 == 0, F.col("valid_from")).alias("valid_until"), F.lit("structured").alias("derivation"), "recorded_at", F.array().cast("array<long>").alias("supersedes"),
    )
    evidence = base.filter(n % 6 != 0).select((n * 10).alias("seq"), F.concat(F.lit("status is "), "value", F.lit(".")).alias("body"), F.lit("user").alias("role"), F.lit("n").alias("namespace"))
    quote = F.when(n % 5 == 0, "nothing").otherwise(F.concat(F.lit("is "), "value"))
    sources = base.filter(n % 17 != 0).select(n, (n * 10).alias("seq"), F.when(n % 7 == 0, "assistant").otherwise("user").alias("role"), quote.alias("quote"), F.when(n % 2 == 0, 7).alias("start"))
    none = base.limit(0).select(n, "subject", F.lit("p").alias("predicate"), F.lit("s").alias("scope"), F.lit("n").alias("namespace"), "recorded_at", F.lit(True).alias("by_user"))
    return cur.claim_violations(writes, sources, evidence, none)


@query(sql("nodes", "SELECT g.id, g.parent, p.parent AS grandparent, (SELECT count(*) FROM nodes k WHERE k.parent = g.id) AS children FROM nodes g JOIN nodes p ON p.id = g.parent"))
def grandchildren(spark, d):
    n = lake.nodes(spark, d).select("id", "parent")
    kids = n.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    two = n.join(n.select(F.col("id").alias("parent"), F.col("parent").alias("grandparent")), "parent")
    return two.join(kids, "id", "left").select("id", "parent", "grandparent", F.coalesce("children", F.lit(0)).alias("children"))


@query(sql("nodes links", "SELECT id, parent, CASE WHEN id = 'r:2' OR parent = 'r:2' OR parent IN (SELECT id FROM nodes WHERE parent = 'r:2') THEN 'retired' ELSE 'accepted' END AS status FROM nodes"))
def retire_subtree(spark, d):
    n = lake.nodes(spark, d).select("id", "parent")
    below = graph.closure(spark, n).filter("ancestor = 'r:2'").select("id").distinct().withColumn("gone", F.lit(True))
    return n.join(below, "id", "left").select("id", "parent", F.when(F.col("gone"), "retired").otherwise("accepted").alias("status"))


@query(sql("nodes links sup", "SELECT n.id, n.title, (SELECT count(*) FROM nodes c WHERE c.parent = n.id) AS n_children, coalesce((SELECT array_to_string(list_sort(list(c.title)), '; ') FROM nodes c WHERE c.parent = n.id), '') AS children, (SELECT count(*) FROM links l WHERE l.node = n.id) AS n_links, (SELECT count(*) FROM links l JOIN sup s ON s.old_seq = l.id WHERE l.node = n.id) AS superseded, coalesce((SELECT string_agg(id || '>' || new_seq, ',' ORDER BY id) FROM links l JOIN sup s ON s.old_seq = l.id WHERE l.node = n.id), '') AS replaced FROM nodes n"))
def node_view(spark, d):
    n, links = lake.nodes(spark, d), lake.links(spark, d)
    kids = n.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("title")), "; ").alias("children"))
    held = links.join(lake.supersessions(spark, d).withColumnRenamed("old_seq", "id"), "id", "left")
    pair = F.when(F.col("new_seq").isNotNull(), F.struct("id", F.concat_ws(">", F.col("id").cast("string"), F.col("new_seq").cast("string")).alias("t")))
    by = held.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n_links"), F.count("new_seq").alias("superseded"), F.array_sort(F.collect_list(pair)).alias("r"))
    out = n.select("id", "title").join(kids, "id", "left").join(by, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    replaced = F.coalesce(F.array_join(F.transform("r", lambda x: x["t"]), ","), F.lit(""))
    return out.select("id", "title", zero("n_children"), F.coalesce("children", F.lit("")).alias("children"), zero("n_links"), zero("superseded"), replaced.alias("replaced"))


@query(sql("asked", "+s AS (SELECT DISTINCT session AS id, parent FROM asked) SELECT s.id, s.parent, coalesce(s.parent, s.id) AS root, (SELECT count(*) FROM s k WHERE k.parent = s.id) AS n_children FROM s WHERE s.parent IS NULL OR s.parent IN (SELECT id FROM s) UNION ALL SELECT s.id, s.parent, s.id, (SELECT count(*) FROM s k WHERE k.parent = s.id) FROM s WHERE s.parent NOT IN (SELECT id FROM s)"))
def session_tree(spark, d):
    return cur.session_tree(lake.asked(spark, d).select(F.col("session").alias("id"), "parent").distinct())


@query(sql("nodes links sup", "+f AS (SELECT DISTINCT l_orderkey AS session, 'n:' || l_suppkey % 25 AS node FROM lineitem), co AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM f x JOIN f y USING (session) WHERE x.node < y.node GROUP BY 1, 2 HAVING count(*) >= 3) SELECT * FROM (SELECT 'contains' AS kind, parent AS a, id AS b, 1 AS weight FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT 'lineage', a.node, b.node, count(*) FROM sup s JOIN links a ON a.id = s.old_seq JOIN links b ON b.id = s.new_seq GROUP BY 2, 3 UNION ALL SELECT 'supersedes', CAST(new_seq AS VARCHAR), CAST(old_seq AS VARCHAR), 1 FROM sup UNION ALL SELECT 'co_occurs', a, b, weight FROM co)"))
def memory_map(spark, d):
    """Edges of four kinds: a class holds another, items go on from one another, replace each other, or occur in the same sessions."""
    nodes, links, sup = lake.nodes(spark, d), lake.links(spark, d), lake.supersessions(spark, d)
    one = F.lit(1).cast("long")
    contains = nodes.filter("parent IS NOT NULL").select(F.lit("contains").alias("kind"), F.col("parent").alias("a"), F.col("id").alias("b"), one.alias("weight"))
    old, new = links.select(F.col("id").alias("old_seq"), F.col("node").alias("a")), links.select(F.col("id").alias("new_seq"), F.col("node").alias("b"))
    lineage = sup.join(old, "old_seq").join(new, "new_seq").groupBy("a", "b").agg(F.count("*").alias("weight"))
    replaced = sup.select(F.lit("supersedes"), F.col("new_seq").cast("string"), F.col("old_seq").cast("string"), one)
    filed = lake.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.concat(F.lit("n:"), (F.col("l_suppkey") % 25).cast("string")).alias("node"))
    family = nodes.filter("parent IS NOT NULL").select(F.col("id").alias("child"), "parent")
    together = op.co_occurrence(filed, 3, family).select(F.lit("co_occurs"), "a", "b", "weight")
    return contains.union(lineage.select(F.lit("lineage"), "a", "b", "weight")).union(replaced).union(together)


_UP = ", up(id, ancestor, parent, up) AS (SELECT id, id, parent, 0 FROM nodes UNION ALL SELECT u.id, n.id, n.parent, u.up + 1 FROM up u JOIN nodes n ON n.id = u.parent WHERE u.up < 64) "


@query(sql("nodes links", "+span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM links)" + _UP + ", dir AS (SELECT node, count(*) AS n, max(ts) AS t FROM links GROUP BY node), rec AS (SELECT 'c:' || c_custkey AS id, (SELECT hi FROM span) - c_custkey * 1728000000 AS rec_at FROM customer WHERE c_custkey % 40 = 1), b AS (SELECT u.ancestor AS node, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n, max(d.t) AS last_ts, coalesce(bool_or(u.id LIKE 'c:%5'), false) AS protected, max(rec.rec_at) AS rec_at FROM up u LEFT JOIN dir d ON d.node = u.id LEFT JOIN rec ON rec.id = u.id GROUP BY 1) SELECT node, n, last_ts, protected, coalesce(hi - rec_at <= 0.34 * (hi - lo), false) AS warm, coalesce(hi - last_ts >= 0.34 * (hi - lo), false) AND NOT protected AND NOT coalesce(hi - rec_at <= 0.34 * (hi - lo), false) AS collapsible FROM b, span", True))
def branch_states(spark, d):
    nodes, links = lake.nodes(spark, d), lake.links(spark, d)
    low, high = links.agg(F.min("ts"), F.max("ts")).first()
    direct = links.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    protected = nodes.filter("id LIKE 'c:%5'").select("id")
    key = F.col("c_custkey")
    recalled = lake.table(spark, d, "customer").filter(key % 40 == 1).select(F.concat(F.lit("c:"), key.cast("string")).alias("id"), (F.lit(high) - key * DAY_MS * 20).alias("at"))
    return cur.branch_states(nodes, graph.closure(spark, nodes), direct, protected, recalled, low, high)


@query(sql("prompts links", "+lake AS (SELECT min(ts) AS lo, max(ts) AS hi FROM links), last AS (SELECT node, max(ts) AS t FROM links GROUP BY node), p AS (SELECT id, strlen(body) AS bytes, 'c:' || id % 200 AS node, (SELECT hi FROM lake) - id * 3600000 AS ts FROM prompts), due AS (SELECT p.id, p.bytes FROM p LEFT JOIN last l USING (node), lake WHERE bytes >= 2048 AND id % 13 <> 5 AND CASE WHEN l.t IS NULL THEN hi - p.ts > 7 * 86400000 ELSE hi - l.t >= 0.34 * (hi - lo) END) SELECT id, bytes FROM due ORDER BY bytes DESC, id LIMIT 40"))
def compaction_candidates(spark, d):
    """Long machine texts whose node is cold, or without one and old by the lake's own time; noted ones are left alone."""
    links = lake.links(spark, d)
    low, high = links.agg(F.min("ts"), F.max("ts")).first()
    last = links.groupBy("node").agg(F.max("ts").alias("last_ts"))
    p = lake.prompts(spark, d).select("id", F.octet_length("body").alias("bytes"), F.concat(F.lit("c:"), (F.col("id") % 200).cast("string")).alias("node"), (F.lit(high) - F.col("id") * 3_600_000).alias("ts"))
    cold = F.when(F.col("last_ts").isNull(), high - F.col("ts") > 7 * DAY_MS).otherwise(high - F.col("last_ts") >= cur.FRESH * (high - low))
    due = p.filter("bytes >= 2048 AND id % 13 <> 5").join(last, "node", "left").filter(cold)
    return due.orderBy(F.desc("bytes"), "id").limit(40).select("id", "bytes")


@query(sql("links", "+o AS (SELECT 'c:' || c_custkey AS node, 800000000000 + c_custkey * 1000000000 AS seen FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT node, count(*) AS n, max(ts) AS last_ts FROM links GROUP BY node HAVING count(*) >= 5) SELECT n.node, n.n, n.last_ts FROM n LEFT JOIN o USING (node) WHERE seen IS NULL OR last_ts > seen ORDER BY last_ts DESC, node LIMIT 3"))
def observation_nodes(spark, d):
    """Nodes with enough items and news since they were last observed."""
    key = F.col("c_custkey")
    seen = lake.table(spark, d, "customer").filter(key % 3 == 0).select(F.concat(F.lit("c:"), key.cast("string")).alias("node"), (key * 1_000_000_000 + 800_000_000_000).alias("seen"))
    n = lake.links(spark, d).groupBy("node").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).filter("n >= 5")
    due = n.join(seen, "node", "left").filter("seen IS NULL OR last_ts > seen")
    return due.orderBy(F.desc("last_ts"), "node").limit(3).select("node", "n", "last_ts")


@query(sql("ledger nodes", "SELECT seq AS op, CASE WHEN seq % 10 = 0 THEN 'no parent' WHEN seq % 10 = 1 THEN 'no target' WHEN kind = 'signup' THEN 'other kind' WHEN seq % 3 = 0 THEN 'apply' WHEN seq % 7 = 0 THEN 'apply' WHEN 'p' || seq % 4 = 'p1' THEN 'apply' ELSE 'provenance' END AS verdict FROM ledger"))
def adjudicate_files(spark, d):
    """Filings under the general root and under a project's, some without a parent or a target, of another kind or from elsewhere."""
    n, name = F.col("seq"), F.lit("p1")
    own = F.concat(F.lit("root-"), F.substring(F.sha2(name, 256), 1, 12))
    ops = lake.ledger(spark, d).select(
        n.alias("op"), F.when(n % 10 == 0, "lost").when(n % 3 == 0, "a").otherwise("b").alias("parent"), F.when(F.col("kind") == "signup", "note").otherwise(F.col("kind")).alias("target_kind"),
        F.when(n % 10 == 1, n + 10_000_000).otherwise(n).alias("seq"),
    )
    roots = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("node"), F.when(F.col("id") == 0, cur.GENERAL).otherwise(own).alias("root"))
    projects = lake.ledger(spark, d).select("seq", F.when(n % 7 != 0, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("project"))
    return cur.adjudicate_files(ops, roots, lake.ledger(spark, d).select("seq", "kind"), projects)


@query(sql("nodes", "SELECT 'op ' || id AS op, CASE WHEN parent IS NULL THEN 'no parent' ELSE 'redirect' END AS verdict, CASE WHEN parent IS NULL THEN '' ELSE id END AS twins FROM nodes UNION ALL SELECT 'new ' || id, 'apply', '' FROM nodes WHERE id LIKE 'r:%'"))
def adjudicate_creates(spark, d):
    n = lake.nodes(spark, d)
    again = n.select(F.concat(F.lit("op "), "id").alias("op"), F.coalesce("parent", F.lit("lost")).alias("parent"), F.concat(F.lower("title"), F.lit("!")).alias("title"))
    new = n.filter("id LIKE 'r:%'").select(F.concat(F.lit("new "), "id"), F.col("id"), F.lit("A class of its own"))
    out = cur.adjudicate_creates(again.union(new), n)
    return out.select("op", "verdict", F.array_join("twins", ",").alias("twins"))


@query(sql("nodes", "SELECT id AS op, CASE WHEN id LIKE 'n:%' THEN 'apply' WHEN id LIKE 'r:%' THEN 'cycle' WHEN id = 'c:1' THEN 'no parent' WHEN id LIKE 'c:%0' THEN 'depth' ELSE 'apply' END AS verdict FROM nodes"))
def adjudicate_moves(spark, d):
    """Nations become roots, regions go below themselves, customers go to a region, or below another customer, which is too deep."""
    n = lake.nodes(spark, d)
    to = F.when(F.col("id").startswith("n:"), None).when(F.col("id").startswith("r:"), F.col("id")).when(F.col("id") == "c:1", "lost").when(F.col("id").endswith("0"), "c:3").otherwise("r:1")
    ops = n.select(F.col("id").alias("op"), F.col("id").alias("node"), to.alias("new_parent"))
    return cur.adjudicate_moves(ops, n, graph.closure(spark, n), most=2)


@query(sql("nodes links", "+t AS (SELECT id, CASE WHEN id = 'n:3' THEN 'r:4' WHEN parent = 'n:5' THEN 'n:6' ELSE parent END AS parent, CASE WHEN id IN ('n:5', 'n:9') THEN 7 END AS retired_by FROM nodes), l AS (SELECT id, CASE WHEN id % 2 = 0 AND id < 100 THEN 'c:2' ELSE node END AS node FROM links) SELECT 'node' AS part, id, parent AS \"to\", retired_by FROM t UNION ALL SELECT 'link', CAST(id AS VARCHAR), node, NULL FROM l"))
def applied_ops(spark, d):
    """A run that moves a nation, merges one into another, splits links off and collapses one."""
    op_ = "run int, op string, node string, to string, part long"
    fixed = spark.createDataFrame([(7, "promote", "n:3", "r:4", None), (7, "merge", "n:5", "n:6", None), (7, "collapse", "n:9", None, None)], op_)
    split = lake.links(spark, d).filter("id % 2 = 0 AND id < 100").select(F.lit(7).alias("run"), F.lit("split").alias("op"), "node", F.lit("c:2").alias("to"), F.col("id").alias("part"))
    nodes, links = cur.apply_ops(lake.nodes(spark, d), lake.links(spark, d), fixed.union(split))
    out = nodes.select(F.lit("node").alias("part"), "id", F.col("parent").alias("to"), "retired_by")
    return out.union(links.select(F.lit("link"), F.col("id").cast("string"), "node", F.lit(None).cast("int")))


_JOURNAL = "+j AS (SELECT o_orderkey % 50 AS run, o_orderkey AS op, o_custkey AS subject, o_orderstatus AS before, o_orderkey % 6 = 5 AS reverted FROM orders) "


@query(sql("links", _JOURNAL + ", s AS (SELECT DISTINCT run, subject FROM j WHERE NOT reverted) SELECT run, bool_and(run = (SELECT max(o.run) FROM s o WHERE o.subject = s.subject)) AS ok FROM s GROUP BY run"))
def revertible_runs(spark, d):
    return cur.revertible(_journal(spark, d))


def _journal(spark, d):
    o, key = lake.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select((key % 50).alias("run"), key.alias("op"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("before"), (key % 6 == 5).alias("reverted"))


@query(sql("links", _JOURNAL + "SELECT c.c_custkey AS subject, coalesce((SELECT min_by(before, op) FROM j WHERE run = 49 AND subject = c.c_custkey), c.c_mktsegment) AS value FROM customer c"))
def reverted_run(spark, d):
    now = lake.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("value"))
    return cur.revert(now, _journal(spark, d), 49)


@query(sql("vecs", "SELECT 'documents' AS frame, count(*) AS n FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'vectors', count(*) FROM vecs WHERE id % 10 <> 3 OR id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 <> 3 OR doc_id NOT IN (SELECT doc_id FROM documents)"))
def forgotten(spark, d):
    """Forgetting takes a source out of every frame derived from it."""
    source = lambda t, c: lake.table(spark, d, t).select(F.col(c).alias("source"))
    left = cur.forget({"documents": source("documents", "doc_id"), "vectors": source("embeddings", "vec_id"), "labels": source("labels", "doc_id")}, source("documents", "doc_id").filter("source % 10 = 3"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, df in left.items()]
    return out[0].union(out[1]).union(out[2])


@query(sql("links", "SELECT id, CASE WHEN id % 5 >= 3 OR (SELECT max(ts) FROM links) > ts + 60480000000 THEN 'expired' WHEN id % 5 > 0 AND 20 - id % 21 < [1, 2, 4][least(greatest(id % 5, 1), 3)] THEN 'waiting' ELSE 'due' END AS state FROM links"))
def proposal_queue(spark, d):
    links = lake.links(spark, d)
    newest = links.agg(F.max("ts")).first()[0]
    queue = links.select("id", (F.col("id") % 5).alias("attempts"), (F.col("id") % 21).alias("failed_run"), F.col("ts").alias("created"))
    return cur.queue_state(queue, 20, newest, DAY_MS * 100)


@query(sql("asked ledger", "SELECT a.seq, CASE WHEN a.turn % 2 = 0 THEN a.principal WHEN l.seq IS NOT NULL THEN coalesce(c.c_name, l.author) END AS principal FROM asked a LEFT JOIN ledger l ON l.seq = a.seq // 1000 LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = l.author AND c.c_custkey % 2 = 0"))
def stamped_rows(spark, d):
    rows = lake.asked(spark, d).select("seq", F.when(F.col("turn") % 2 == 0, F.col("principal")).alias("principal"), F.floor(F.col("seq") / 1000).cast("long").alias("event"))
    alias = lake.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("author"), F.col("c_name").alias("alias"))
    events = lake.ledger(spark, d).select(F.col("seq").alias("event"), "author").join(rows.select("seq", "event"), "event").select("seq", "author")
    return cur.stamped(rows.select("seq", "principal"), events, alias)


@query(sql("ledger", "+p AS (SELECT seq AS probe, CASE seq % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'prompt_span' ELSE 'note' END AS subject, seq % 7 <> 0 AS was, seq % 7 <> 0 AND NOT (seq % 3 = 0 AND seq % 50 = 0) AND NOT (seq % 3 = 1 AND seq % 10 = 1) AS now FROM ledger), g AS (SELECT subject, count(*) AS n, avg(CAST(was AS DOUBLE)) AS before, avg(CAST(now AS DOUBLE)) AS after FROM p GROUP BY ROLLUP (subject)) SELECT coalesce(subject, 'all') AS subject, n, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN subject IS NULL THEN before - after > greatest(0.05, 3.0 / n) WHEN subject IN ('decision', 'note') THEN after < before ELSE false END AS regressed FROM g"))
def canary_regression(spark, d):
    n = F.col("seq")
    rows = lake.ledger(spark, d).select(n.alias("probe"), F.when(n % 3 == 0, "decision").when(n % 3 == 1, "prompt_span").otherwise("note").alias("subject"), (n % 7 != 0).alias("hit"))
    after = rows.withColumn("hit", F.col("hit") & ~((F.col("probe") % 3 == 0) & (F.col("probe") % 50 == 0)) & ~((F.col("probe") % 3 == 1) & (F.col("probe") % 10 == 1)))
    out = cur.canary(rows, after)
    return out.select(F.coalesce("subject", F.lit("all")).alias("subject"), "n", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "regressed")


@query(sql("links ledger", "SELECT node, max(greatest(l.ts, coalesce(e.ts, 0))) AS warm_at, count(e.seq) AS recalls FROM links l LEFT JOIN ledger e ON e.seq = l.id GROUP BY node"))
def warmth(spark, d):
    """When a node was last touched: by its links, or by an event that recalled one of them."""
    events = lake.ledger(spark, d).select(F.col("seq").alias("id"), F.col("ts").alias("at"))
    rows = lake.links(spark, d).join(events, "id", "left")
    return rows.groupBy("node").agg(F.max(F.greatest("ts", F.coalesce("at", F.lit(0)))).alias("warm_at"), F.count("at").alias("recalls"))


@query(sql("indexed", "+q AS (SELECT v FROM indexed WHERE target = 0 AND chunk = 1), ok AS (SELECT i.* FROM indexed i WHERE model = 'new' AND kind = 'prompt') SELECT target, round(max(list_cosine_similarity(o.v, q.v)), 6) AS score, count(*) AS chunks FROM ok o, q GROUP BY target ORDER BY score DESC, target LIMIT 20"))
def semantic_search(spark, d):
    """All chunks of the eligible targets of one model; a target counts by its best."""
    i = lake.indexed(spark, d)
    probe = F.broadcast(i.filter("target = 0 AND chunk = 1").select(F.col("v").alias("q")))  # one row
    scored = i.filter("model = 'new' AND kind = 'prompt'").crossJoin(probe).select("target", vx.cosine("v", "q").alias("s"))
    return scored.groupBy("target").agg(F.round(F.max("s"), 6).alias("score"), F.count("*").alias("chunks")).orderBy(F.desc("score"), "target").limit(20)


@query(sql("pagev", "SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY context_hash, id % 40 ORDER BY length(text) DESC, id) AS r FROM pagev) WHERE r = 1"))
def page_dedup(spark, d):
    """Of pages with the same content, the first in rank."""
    rows = lake.pages(spark, d).withColumn("visit", F.col("id") % 40)
    return cur.ranked_first(rows, ["context_hash", "visit"], [F.desc(F.length("text")), F.asc("id")]).select("id", "url")


@query()
def greedy_dedup(spark, d):
    """The longest of near copies in each language among the sixty longest texts: what stays, and what it absorbs."""
    best = lake.prompts(spark, d).orderBy(F.desc(F.length("body")), "id").limit(60)
    rows = simhash.with_fingerprint(best.withColumn("size", F.length("body")), "body")
    return simhash.greedy(rows, ["surface"], "id", [F.desc("size"), F.asc("id")], exact="body_hash").select("id", "absorbed")


@query()
def echoes(spark, d):
    """Assistant texts that nearly repeat what was put before them, found by fingerprint."""
    t = simhash.with_fingerprint(lake.turns(spark, d), "body")
    said = t.filter("role = 'assistant'").select("seq", "session", "simhash")
    near = simhash.near_within(said, t.filter("role <> 'assistant'"), "session", "seq")
    return said.select("seq").join(near.withColumn("echo", F.lit(True)), "seq", "left").select("seq", F.coalesce("echo", F.lit(False)).alias("echo"))


_TITLES = "+tok AS (SELECT id, title, parent, string_split_regex(lower(title || ' ' || coalesce(parent, '')), '[^a-z0-9]+') AS t FROM nodes), m AS (SELECT *, CAST(list_contains(t, 'customer') AS INT) + CAST(list_contains(t, '000000007') AS INT) AS exact, CAST(NOT list_contains(t, 'customer') AND len(list_filter(t, lambda x: starts_with(x, 'customer'))) > 0 AS INT) + CAST(NOT list_contains(t, '000000007') AND len(list_filter(t, lambda x: starts_with(x, '000000007'))) > 0 AS INT) AS prefix FROM tok) "


@query(sql("nodes", _TITLES + ", s AS (SELECT *, count(*) OVER () AS n, max(exact + prefix) OVER () AS widest FROM m WHERE exact >= 1), b AS (SELECT id, title, exact, prefix FROM s WHERE exact + prefix = widest AND NOT (widest = 1 AND n > 1)) SELECT id, title, exact, prefix FROM b ORDER BY exact DESC, length(title), id LIMIT 1"))
def node_resolution(spark, d):
    n = lake.nodes(spark, d)
    words = F.split(F.lower(F.concat_ws(" ", "title", F.coalesce("parent", F.lit("")))), "[^a-z0-9]+")
    return search.resolve(n.withColumn("t", words), ["customer", "000000007"], [F.desc("exact"), F.length("title"), F.asc("id")]).select("id", "title", "exact", "prefix")


_WANTED = ["blue", "bolt"]


@query(sql("notes", f"+toks AS (SELECT *, {_terms_sql('text')} AS t FROM notes)" + _bm25_sql(_WANTED, [("t", 1.0)]) + ", x AS (SELECT max(updated) AS newest FROM notes) SELECT id, text, round(score + 0.2 * greatest(0, 1 - (newest - updated) * 100000.0 / 2592000000.0) + CASE WHEN starred THEN 0.1 ELSE 0 END, 5) AS score FROM r, x WHERE n_terms > 0 ORDER BY score DESC, length(text), id LIMIT 40"))
def node_match_order(spark, d):
    """Matches by BM25 with a little for what is new and for what was accepted; shorter titles first among equals."""
    notes = lake.notes(spark, d)
    found = search.bm25(lake.note_index(spark, d), _WANTED).withColumnRenamed("score", "match")
    newest = notes.agg(F.max("updated").alias("newest"))  # one row
    recent = 0.2 * F.greatest(F.lit(0.0), 1 - (F.col("newest") - F.col("updated")) * 100_000.0 / 2_592_000_000.0)
    score = F.round("match", 6) + recent + F.when(F.col("starred"), 0.1).otherwise(0.0)
    rows = notes.join(found, F.col("id") == F.col("key")).crossJoin(F.broadcast(newest)).select("id", "text", F.round(score, 5).alias("score"))
    return rows.orderBy(F.desc("score"), F.length("text"), "id").limit(40)
