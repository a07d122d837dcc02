"""Nearest neighbours by a vantage-point tree in every shard.

Rows are dealt into shards of about SHARD_ROWS at most. A shard's rows come first, its tree is built once, and the queries
follow in a stream, searched batch by batch: no row is copied, and what a task holds is one shard. A subtree is skipped where
the triangle inequality, with the current k-th distance multiplied by `factor`, rules it out: factor 1 is exact search,
smaller ones prune more.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut
from quarry.llm.vectors import finite_vectors, matrix

SHARD_ROWS, LEAF = 32768, 128
#: Tables of fewer rows are dealt into smaller shards, so that they still keep several tasks busy.
SMALL_SHARD, LEAST_SHARDS = 4096, 64
#: Numbers in one temporary array of a search.
LEAF_CELLS = 1 << 20


class VantageTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, seed: int = 1):
        self.points, self.ids, self.rng = points, ids, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = self.points[self.rng.choice(rows)]
        d = _distance(vantage[None], self.points[rows])[0]
        radius = np.median(d)
        inner = d <= radius
        if inner.all() or not inner.any():  # many copies
            return rows
        return vantage, d[inner].max(), d[~inner].min(), self._build(rows[inner]), self._build(rows[~inner])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0):
        """(distances, ids) of each query's k nearest, ascending, ties to smaller ids; own: ids that are not candidates."""
        best_d = np.full((len(queries), k), np.inf)
        best_i = np.full((len(queries), k), np.iinfo(np.int64).max)

        def leaf(rows, q):
            step = max(1, LEAF_CELLS // len(rows))  # copies make long leaves
            for s in range(0, len(q), step):
                compare(rows, q[s : s + step])

        def compare(rows, q):
            d = _distance(queries[q], self.points[rows])
            i = np.broadcast_to(self.ids[rows], d.shape)
            d = np.where(i == own[q][:, None], np.inf, d)
            d, i = np.hstack([best_d[q], d]), np.hstack([best_i[q], i])
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d[q], best_i[q] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        def visit(node, q):
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                return leaf(node, q)
            vantage, inner_max, outer_min, inner, outer = node
            d = _distance(queries[q], vantage[None])[:, 0]
            near = d <= (inner_max + outer_min) / 2
            reach = lambda p: best_d[p, -1] * factor * (1 + 1e-9) + 1e-12
            visit(inner, q[near])
            visit(outer, q[near][d[near] + reach(q[near]) >= outer_min])
            far = ~near
            visit(outer, q[far])
            visit(inner, q[far][d[far] - reach(q[far]) <= inner_max])

        visit(self.root, np.arange(len(queries)))
        return best_d, best_i


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, LEAF_CELLS // max(1, b.size))
    for s in range(0, len(a), step):
        out[s : s + step] = np.sqrt(((a[s : s + step, None] - b[None]) ** 2).sum(-1))
    return out


def nearest(table: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k Euclidean nearest of every row whose vec_id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite components take no part, and neither do rows without a
    vec_id; vectors of different lengths are never compared. With fewer candidates than k, all are returned.
    """

    def run(batches):
        of, rows, tree = None, [], None
        for b in batches:
            p = b.to_pandas()
            kinds = p[["shard", "dim", "asked"]].to_numpy()
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1).tolist(), len(p)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = p.iloc[i:j]
                if len(part) and (key := (part.shard.iloc[0], part.dim.iloc[0])) != of:
                    of, rows, tree = key, [], None
                if not len(part) or not part.asked.iloc[0]:
                    rows.append(part[["id", "v"]])
                    continue
                if tree is None and rows:
                    all_ = pd.concat(rows).sort_values("id")
                    tree, rows = VantageTree(matrix(all_.v), all_.id.to_numpy()), []
                if tree is None:
                    continue
                d, found = tree.search(matrix(part.v), part.id.to_numpy(), min(k, len(tree.ids)), factor)
                ok = np.isfinite(d.ravel())
                columns = np.repeat(part.id.to_numpy(), d.shape[1])[ok], found.ravel()[ok], d.ravel()[ok]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    rows = cut(finite_vectors(table).filter("valid").select("id", "v", F.size("v").alias("dim")))
    is_query = F.col("id") % every == 0
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS), min(LEAST_SHARDS, -(-n // SMALL_SHARD)))
    data = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("asked", F.lit(False))
    asked = rows.filter(is_query).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(True))
    dealt = data.union(asked).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "asked")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
