"""Vector search, fusion, near-duplicates and filing by centroids."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import vector as vx
from quarry.operators import search, simhash
from quarry.operators.lineage import cut
from quarry.registry import query
from quarry.sources import lake
from quarry.sources.lake import sql

_COS = "list_cosine_similarity({}, {})"


def _probe(spark, d, k=0):
    return F.broadcast(lake.vectors(spark, d).filter(F.col("id") == k).select(F.col("v").alias("q")))  # one row


@query(sql("vecs", "SELECT a.id, round(" + _COS.format("a.v", "q.v") + ", 6) AS score FROM vecs a, vecs q WHERE q.id = 0 AND a.id <> 0 ORDER BY score DESC, a.id LIMIT 50"))
def cosine_topk(spark, d):
    rows = lake.vectors(spark, d).filter("id <> 0").crossJoin(_probe(spark, d))
    return rows.select("id", F.round(vx.cosine("v", "q"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(sql("vecs", "+n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vecs), z AS (SELECT id, u, list_max(list_transform(u, lambda x: abs(x))) / 127.0 AS scale FROM n), c AS (SELECT id, scale, list_transform(u, lambda x: CAST(greatest(least(round(x / scale), 127), -127) AS DOUBLE)) AS c FROM z) SELECT a.id, round(list_dot_product(a.c, q.c) * a.scale * q.scale, 6) AS score FROM c a, c q WHERE q.id = 0"))
def quantized_cosine(spark, d):
    codes, scale = vx.quantize(F.col("v"))
    rows = lake.vectors(spark, d).select("id", codes.alias("c"), scale.alias("s"))
    probe = F.broadcast(rows.filter("id = 0").select(F.col("c").alias("qc"), F.col("s").alias("qs")))
    return rows.crossJoin(probe).select("id", F.round(vx.int_dot("c", "qc") * F.col("s") * F.col("qs"), 6).alias("score"))


@query(sql("vecs", "SELECT a.id // 5 AS target, round(max(" + _COS.format("a.v", "q.v") + "), 6) AS score FROM vecs a, vecs q WHERE q.id = 0 GROUP BY 1 ORDER BY score DESC, target LIMIT 20"))
def max_chunk_topk(spark, d):
    rows = lake.vectors(spark, d).crossJoin(_probe(spark, d))
    scored = rows.select(F.floor(F.col("id") / 5).cast("long").alias("target"), vx.cosine("v", "q").alias("s"))
    return scored.groupBy("target").agg(F.round(F.max("s"), 6).alias("score")).orderBy(F.desc("score"), "target").limit(20)


@query(sql("vecs prompts", "+arms AS (SELECT 'semantic' AS arm, key, row_number() OVER (ORDER BY s DESC, key) AS rank FROM (SELECT a.id AS key, round(" + _COS.format("a.v", "q.v") + ", 9) AS s FROM vecs a, vecs q WHERE q.id = 0 ORDER BY s DESC, key LIMIT 60) UNION ALL SELECT 'length', key, row_number() OVER (ORDER BY n DESC, key) FROM (SELECT id AS key, length(body) AS n FROM prompts ORDER BY n DESC, key LIMIT 60)) SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(arm, ',' ORDER BY arm) AS arms FROM arms GROUP BY key"))
def rrf_fusion(spark, d):
    scored = lake.vectors(spark, d).crossJoin(_probe(spark, d)).select("id", F.round(vx.cosine("v", "q"), 9).alias("s"))
    a = search.rank(scored, "semantic", "id", [F.desc("s"), F.asc("id")], 60)
    b = search.rank(lake.prompts(spark, d).select("id", F.length("body").alias("n")), "length", "id", [F.desc("n"), F.asc("id")], 60)
    return search.fuse(a.union(b)).withColumn("score", F.round("score", 9))


_CENT = "p AS (SELECT node, i, sum(v[i]) AS s FROM vecs, range(1, 65) r(i) GROUP BY node, i), cent AS (SELECT node, list(s ORDER BY i) AS c, (SELECT count(*) FROM vecs x WHERE x.node = p.node) AS n FROM p GROUP BY node)"


def centroids(vectors):
    """(node, c, n): sums of member vectors; partial sums by position, so that a large class is never gathered."""
    at = vectors.select("node", F.posexplode("v").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return at.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("c"), F.max("n").alias("n"))


#: Bytes of centroids that are sent to every task; beyond, vectors meet them in blocks.
SENT = 64 << 20


def _best_two(vectors, cents, own: bool = False):
    """(id, node, top1, score, margin) of each vector's nearest centroid (to, c, n), ties to the smaller class; a class alone has a
    margin of 1. own: a vector is taken out of its own class's centroid first, and a class of it alone doesn't count.

    Centroids that are proven small come to the vectors as one list; else vectors meet the blocks they are dealt to, and each
    block gives its best two.
    """
    size = cents.agg(F.count("*"), F.max(F.size("c"))).first()
    blocks = max(1, -(-size[0] * (size[1] or 0) * 8 // SENT))
    block = F.pmod(F.xxhash64("to"), F.lit(blocks)).cast("int")
    lists = cents.groupBy(block.alias("block")).agg(F.collect_list(F.struct("to", "c", "n")).alias("all"))  # a block is at most about SENT bytes
    if blocks == 1:
        met = vectors.crossJoin(F.broadcast(lists))  # one row
    else:
        met = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(lists, "block")
    centre = lambda x: F.when(x["to"] == F.col("node"), F.zip_with(x["c"], "v", lambda a, b: a - b)).otherwise(x["c"]) if own else x["c"]
    there = F.filter("all", lambda x: (x["n"] > 1) | ~x["to"].eqNullSafe(F.col("node"))) if own else F.col("all")
    scored = met.select("id", "node", F.transform(there, lambda x: F.struct(F.round(vx.cosine(centre(x), "v"), 9).alias("s"), (-x["to"]).alias("neg"))).alias("near"))
    first = scored.withColumn("one", F.array_max("near")).withColumn("two", F.array_max(F.filter("near", lambda x: x["neg"] != F.col("one.neg"))))
    if blocks > 1:
        both = first.groupBy("id", "node").agg(F.flatten(F.collect_list(F.array_compact(F.array("one", "two")))).alias("near"))
        first = both.withColumn("one", F.array_max("near")).withColumn("two", F.array_max(F.filter("near", lambda x: x["neg"] != F.col("one.neg"))))
    out = first.filter("one IS NOT NULL")
    return out.select("id", "node", (-F.col("one.neg")).alias("top1"), F.col("one.s").alias("score"), F.coalesce(F.col("one.s") - F.col("two.s"), F.lit(1.0)).alias("margin"))


def ranked_centroids(vectors):
    """(id, node, top1, score, margin): each vector's nearest centroid of all classes."""
    return _best_two(vectors, centroids(vectors).withColumnRenamed("node", "to"))


_RANKED = "+" + _CENT + ", sc AS (SELECT v.id, v.node, c.node AS \"to\", round(list_cosine_similarity(v.v, c.c), 9) AS s FROM vecs v, cent c), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, \"to\") AS r, s - lead(s) OVER (PARTITION BY id ORDER BY s DESC, \"to\") AS margin FROM sc) "


@query(sql("vecs", _RANKED + "SELECT id, node, \"to\" AS top1, round(s, 6) AS score FROM rk WHERE r = 1"))
def centroid_rank(spark, d):
    return ranked_centroids(lake.vectors(spark, d)).select("id", "node", "top1", F.round("score", 6).alias("score"))


@query(sql("vecs", _RANKED + "SELECT id, CASE WHEN s >= 0.3 AND margin >= 0.05 THEN 'file' ELSE 'inbox' END AS verdict FROM rk WHERE r = 1"))
def margin_decide(spark, d):
    ok = (F.col("score") >= 0.3) & (F.col("margin") >= 0.05)
    return ranked_centroids(lake.vectors(spark, d)).select("id", F.when(ok, "file").otherwise("inbox").alias("verdict"))


_GRID = "g AS (SELECT t.i / 100.0 AS t1, m.i / 100.0 AS margin FROM (SELECT 40 + 5 * i AS i FROM range(0, 10) q(i)) t, (SELECT 2 * i AS i FROM range(0, 11) q(i)) m)"
# The grid's first threshold, its steps, and the precision to be kept.
T1, STEP, GAP, PRECISION = 0.40, 0.05, 0.02, 0.90
_LOO = "+" + _CENT + ", sc AS (SELECT v.id, v.node, c.node AS \"to\", round(list_cosine_similarity(v.v, CASE WHEN c.node = v.node THEN list_transform(list_zip(c.c, v.v), lambda x: x[1] - x[2]) ELSE c.c END), 9) AS s FROM vecs v, cent c WHERE c.n > 1 OR c.node <> v.node), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, \"to\") AS r, s - lead(s) OVER (PARTITION BY id ORDER BY s DESC, \"to\") AS margin FROM sc), " + _GRID + ", cells AS (SELECT t1, margin, (SELECT count(*) FROM rk WHERE r = 1 AND s >= t1 AND round(rk.margin, 9) >= g.margin) AS filed, (SELECT count(*) FROM rk WHERE r = 1 AND s >= t1 AND round(rk.margin, 9) >= g.margin AND \"to\" = node) AS correct FROM g) "


def filing_grid(spark, v):
    """(t1, margin, filed, correct) of leave-one-out filing at every cell of the grid: each vector is counted once, in the last
    cell that it passes, and cells then add up all beyond them."""
    cents = centroids(v).withColumnRenamed("node", "to")
    best = _best_two(v, cents, own=True).filter(F.col("score") >= T1)
    i = F.least(F.floor((F.col("score") - T1) / STEP + 1e-6), F.lit(9))
    j = F.least(F.floor(F.round("margin", 9) / GAP + 1e-6), F.lit(10))
    cells = best.groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"), F.count_if(F.col("top1") == F.col("node")).alias("k"))  # at most 110
    grid = spark.range(110).select(F.floor(F.col("id") / 11).alias("a"), (F.col("id") % 11).alias("b"))
    beyond = grid.join(F.broadcast(cells), (F.col("i") >= F.col("a")) & (F.col("j") >= F.col("b")), "left")
    sums = beyond.groupBy("a", "b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filed"), F.coalesce(F.sum("k"), F.lit(0)).alias("correct"))
    return sums.select(F.round(T1 + F.col("a") * STEP, 2).alias("t1"), F.round(F.col("b") * GAP, 2).alias("margin"), "filed", "correct")


@query(sql("vecs", _LOO + "SELECT t1, margin, filed, correct FROM cells"))
def leave_one_out_grid(spark, d):
    return filing_grid(spark, lake.vectors(spark, d))


@query(sql("vecs", _LOO + "SELECT t1, margin, filed FROM cells WHERE filed > 0 AND correct >= 0.9 * filed ORDER BY filed DESC, t1 DESC, margin DESC LIMIT 1"))
def filing_thresholds(spark, d):
    """The cell with the most filed among those that are right often enough; of equals the stricter."""
    ok = filing_grid(spark, lake.vectors(spark, d)).filter((F.col("filed") > 0) & (F.col("correct") >= PRECISION * F.col("filed")))
    return ok.orderBy(F.desc("filed"), F.desc("t1"), F.desc("margin")).limit(1).select("t1", "margin", "filed")


@query(sql("prompts", "SELECT id, first_value(id) OVER (PARTITION BY body_hash ORDER BY id) AS kept FROM prompts"))
def exact_dedup(spark, d):
    p = lake.prompts(spark, d).select("id", "body_hash")
    # least id per hash, joined back: copies are counted before they are moved
    return p.join(p.groupBy("body_hash").agg(F.min("id").alias("kept")), "body_hash").select("id", "kept")


@query()
def simhash_pairs(spark, d):
    marked = simhash.with_fingerprint(lake.prompts(spark, d).select("id", "body"), "body").select("id", "simhash")
    return simhash.near_pairs(cut(marked), "id")  # made once, as pairs read them several times
