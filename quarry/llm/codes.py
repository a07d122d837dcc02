"""Vector code compression: product codes whose codebooks are trained by the filtering form of Lloyd's rounds.

Vectors become integers and are cut into parts. Each partition builds kd-trees over at most CHUNK rows, one tree for each
part, with the box, the sum and the count of every node. A round walks each tree from its root with the codebook's
entries as candidates: an entry that is farther than another one from every point of a node's box is dropped there, and a
node with one entry left gives it its cached sum and count at once. Leaves with several entries left compare their points.

All is integer arithmetic and exact: ties go to the lower entry in the filter as well as in the leaves. Between rounds
only sums and counts of (part, entry) go to the driver, ENTRIES x dimensions numbers at most.
"""

import pickle
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of one set of trees, and the most points of a leaf.
CHUNK, LEAF = 16384, 16
#: Larger components have no exact squared distances in 64 bits.
MOST = 32768.0


class Tree:
    """An implicit balanced kd-tree: node k of level l holds the points of places n * k >> l up to n * (k + 1) >> l."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        order, self.levels = np.arange(n), []
        for level in range(self.depth + 1):
            starts = n * np.arange(1 << level, dtype=np.int64) >> level
            p = points[order]
            low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
            self.levels.append((low, high, np.add.reduceat(p.astype(np.int64), starts)))
            if level < self.depth:  # the next level's halves: by the widest side of each box
                node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
                side = np.argmax(high.astype(np.int64) - low, axis=1)
                order = order[np.lexsort((p[np.arange(n), side[node]], node))]
        self.order, self.points = order.astype(np.int32), points[order]

    def bounds(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.points)
        return n * nodes >> level, n * (nodes + 1) >> level

    def walk(self, entries: np.ndarray):
        """(level, nodes, entry of each) of subtrees with one entry left, and at last (None, places, entry of each) of leaves' points."""
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        index = np.arange(len(entries))
        for level, (low, high, _) in enumerate(self.levels):
            lo, hi = low[nodes].astype(np.int64), high[nodes].astype(np.int64)
            middle = ((lo + hi)[:, None] - 2 * entries) ** 2
            best = np.argmin(np.where(left, middle.sum(2), np.iinfo(np.int64).max), axis=1)
            mine = entries[best][:, None]
            corner = np.where(entries > mine, hi[:, None], lo[:, None])  # where the box favours an entry most
            worse = ((corner - entries) ** 2 - (corner - mine) ** 2).sum(2)
            left &= ~((worse > 0) | ((worse == 0) & (index > best[:, None])))
            single = left.sum(1) == 1
            yield level, nodes[single], best[single]
            nodes, left = nodes[~single], left[~single]
            if not len(nodes):
                return
            if level < self.depth:
                nodes, left = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([left, left])
        start, end = self.bounds(self.depth, nodes)
        which = np.repeat(np.arange(len(nodes)), end - start)
        places = np.arange(len(which)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[which]
        apart = ((self.points[places].astype(np.int64)[:, None] - entries) ** 2).sum(2)
        yield None, places, np.argmin(np.where(left[which], apart, np.iinfo(np.int64).max), axis=1)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry."""
        total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for level, which, entry in self.walk(entries):
            if level is None:
                np.add.at(total, entry, self.points[which].astype(np.int64))
                np.add.at(count, entry, 1)
            else:
                start, end = self.bounds(level, which)
                np.add.at(total, entry, self.levels[level][2][which])
                np.add.at(count, entry, end - start)
        return total, count

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point and its squared distance, in the order in which the points were given."""
        placed = np.zeros(len(self.points), np.int64)
        for level, which, entry in self.walk(entries):
            if level is None:
                placed[which] = entry
            else:
                for a, b, e in zip(*self.bounds(level, which), entry):
                    placed[a:b] = e
        apart = ((self.points.astype(np.int64) - entries[placed]) ** 2).sum(1)
        codes, errors = np.zeros_like(placed), np.zeros_like(apart)
        codes[self.order], errors[self.order] = placed, apart
        return codes, errors


def _integers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(SCALE * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int32).reshape(-1, size)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds only components that are there, finite and less than MOST in size."""
    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(MOST), F.lit(False))))


def _chunks(batches, of):
    """Batches joined to CHUNK rows each."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, CHUNK - n)
            held, n, b = [*held, take], n + take.num_rows, b.slice(take.num_rows)
            if n == CHUNK:
                yield of(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield of(pa.Table.from_batches(held))


def _planted(rows: DataFrame, size: int) -> DataFrame:
    """One row for each chunk: ids, labels and the trees of its parts."""
    width = size // PARTS

    def build(batches):
        def of(t: pa.Table) -> pa.RecordBatch:
            whole = _integers(t["v"].combine_chunks(), size)
            trees = [pickle.dumps(Tree(np.ascontiguousarray(whole[:, k * width : (k + 1) * width])), protocol=5) for k in range(PARTS)]
            columns = [pa.array([t[c].to_pylist()], pa.list_(t.schema.field(c).type)) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

        yield from _chunks(batches, of)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(build, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<binary>")


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment of all parts: floored means, and old entries where nothing is nearest."""

    def add(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for blobs in b.column(0):
                for k, blob in enumerate(blobs):
                    s, c = pickle.loads(blob.as_py()).totals(books[k])
                    total[k] += s
                    count[k] += c
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        columns = [part, entry, place, total.ravel(), np.repeat(count.ravel(), books.shape[2])]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["part", "entry", "place", "total", "n"])

    sums = trees.select("trees").mapInArrow(add, "part long, entry long, place long, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        if r.n:
            out[r.part, r.entry, r.place] = r.total // r.n
    return out


def compress(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error) of each vector kept, and the codebooks as parts x entries x components.

    Vectors that are null or hold null, non-finite or oversized components (|x| >= MOST) are dropped, and so are vectors
    whose length isn't that of the kept vector with the smallest id or can't be cut into PARTS; empty ones too. The first
    entries are the vectors of the ENTRIES smallest ids (nulls last; rows that repeat an id count each, ordered by their
    components); with fewer vectors there are fewer entries. Without any, the frame is empty and there are no codebooks.
    Other columns are ignored.
    """
    kept = usable(rows, vector).filter((F.size(vector) > 0) & (F.size(vector) % PARTS == 0))
    kept = kept.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kinds = dict(kept.dtypes)
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not first:
        return rows.sparkSession.createDataFrame([], schema), None
    size = len(first[0].v)
    kept = kept.filter(F.size("v") == size)
    seeds = np.floor(np.array([r.v for r in kept.orderBy(*order).limit(ENTRIES).collect()]) * SCALE).astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), PARTS, size // PARTS).swapaxes(0, 1))
    trees = cut(_planted(kept, size))
    for _ in range(ROUNDS):
        books = _round(trees, books)

    def encode(batches):
        for b in batches:
            for ids, labels, blobs in zip(b.column(0), b.column(1), b.column(2)):
                codes, errors = zip(*(pickle.loads(blob.as_py()).assign(books[k]) for k, blob in enumerate(blobs)))
                code = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
                text = [code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(sum(errors))], ["id", "label", "code", "error"])

    return trees.mapInArrow(encode, schema), books


def digest(books: np.ndarray | None) -> str:
    return sha256(",".join(map(str, ([] if books is None else books.ravel().tolist()))).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """compress() with each label's summed error and the digest of the codebooks."""
    coded, books = compress(rows, id_column, vector, label)
    coded = cut(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
