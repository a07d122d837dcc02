"""Near-duplicate groups by SetSketch registers.

A sketch keeps, for each of `BANDS * ROWS` registers, the truncated exponentially spaced minimum
K = floor(1 - log_b(x)), x the smallest exponential variate of the set's elements. Registers merge by maximum
and are equal for two sets about as often as the sets overlap. Bands of registers find candidates, the joint
likelihood of both sketches at the known set sizes drops hopeless ones, and full sets confirm the rest.

A bucket is never expanded into all its pairs. Copies with equal sets are one class. In a bucket of classes each
is compared with one pivot; components of the confirmed links then tell which bucket members may still be
linked unknown to us, and only pairs of different components are compared: directly in small buckets, and in
blocks by matrix products in large ones, which give a spanning forest of the links they confirm.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HashKey, blocks, cut, mix, shingle_sets, string_buffer, word_hashes
from quarry.llm.components import components

BANDS, ROWS = 16, 4
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
SMALL_BUCKET, BLOCK = 24, 384
#: Log-likelihood ratio beyond which a similarity at the threshold is given up (about six standard deviations).
GIVE_UP = 18.0
ITEM_SCHEMA = "id long, n long, digest binary, sketch binary"

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def sketch(members: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes; an empty set has zeros."""
    by = _MULTIPLIERS[:registers]
    low = np.full(registers, 2**64 - 1, np.uint64)
    if not len(members):
        return np.zeros(len(low), np.uint16)
    for s in range(0, len(members), 4096):
        low = np.minimum(low, (members[s : s + 4096, None] * by).min(axis=0))
    return _levels(low)


def sketches(members: np.ndarray, begin: np.ndarray, n: np.ndarray, registers: int) -> np.ndarray:
    """(len(begin), registers): the sketches of stretches of an array of hashes, none of them empty."""
    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    x, first = members[place], np.cumsum(n) - n
    low = np.stack([np.minimum.reduceat(x * by, first) for by in _MULTIPLIERS[:registers]], axis=1)
    return _levels(low)


def _levels(low: np.ndarray) -> np.ndarray:
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    k = np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, LEVELS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def log_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """For each pair of sketches (rows), the joint log-likelihood of the Jaccard similarities in _GRID."""
    u = (n_a / (n_a + n_b))[:, None]
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * _GRID), p((1 - u) - u * _GRID)
    same = a.shape[1] - above - below
    return above * np.log(up + 1e-9) + below * np.log(down + 1e-9) + same * np.log(np.maximum(1 - up - down, 1e-9))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of sketches."""
    return _GRID[log_likelihood(a, b, n_a, n_b).argmax(1)]


def _hopeful(a, b, n_a, n_b, threshold: float) -> np.ndarray:
    like = log_likelihood(a, b, n_a, n_b)
    return like[:, _GRID >= threshold - 1e-9].max(1) >= like.max(1) - GIVE_UP


def _rows(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def text_sets(column: pa.Array, k: int, key: HashKey) -> Iterator[np.ndarray]:
    """Shingle sets of an Arrow text column."""
    buf, off = string_buffer(column)
    for s, e in blocks(off):
        h, bounds = word_hashes(buf[off[s] : off[e]], off[s : e + 1] - off[s], key)
        yield from shingle_sets(h, bounds, k, key)


def items_of(sets: Iterator[np.ndarray], ids: pa.Array, registers: int = BANDS * ROWS) -> pa.RecordBatch:
    n, digest, regs = [], [], []
    for v in sets:
        n.append(len(v))
        digest.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None)
        regs.append(sketch(v, registers).tobytes() if len(v) else None)
    arrays = [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["id", "n", "digest", "sketch"])


def sketch_texts(docs: DataFrame, k: int, hashes: HashKey) -> DataFrame:
    """(id, n, digest, sketch) of the k-word shingle sets of (id, text)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield items_of(text_sets(b.column("text"), k, hashes), b.column("id"))

    return docs.select("id", "text").mapInArrow(run, ITEM_SCHEMA)


def load_text_sets(docs: DataFrame, k: int, hashes: HashKey) -> Callable[[DataFrame], DataFrame]:
    """A loader of (id, members): the shingle sets of the texts with the given ids, made again from the texts."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                sets = [v.tobytes() for v in text_sets(b.column("text"), k, hashes)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], ["id", "members"])

    return lambda ids: docs.select("id", "text").join(ids, "id", "left_semi").mapInArrow(run, "id long, members binary")


def _bands(items: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.stack(_rows(b.column("sketch"), np.uint16)).astype(np.uint64)
            regs = regs.reshape(len(regs), -1, rows)
            key = np.broadcast_to(np.arange(regs.shape[1], dtype=np.uint64), regs.shape[:2]).copy()
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
            ids = np.repeat(b.column("id").to_numpy(), regs.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(ids)], ["key", "id"])

    return items.select("id", "sketch").mapInArrow(run, "key long, id long")


def _hopeful_pairs(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches leave the threshold possible."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = np.stack(_rows(b.column("sa"), np.uint16)), np.stack(_rows(b.column("sb"), np.uint16))
                keep = _hopeful(x, y, b.column("na").to_numpy(), b.column("nb").to_numpy(), threshold)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    left = items.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = items.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _forest(edges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _cell_links(percent: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = cell[cell.side == 0], cell[cell.side == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in [*left.members, *right.members]]
            sizes = np.array([len(x) for x in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), sizes)
            both = np.zeros((len(left), len(right)), np.float32)
            for s in range(0, int(code.max()) + 1, 4096):
                part = (code >= s) & (code < s + 4096)
                m = np.zeros((len(sets), 4096), np.float32)
                m[row[part], code[part] - s] = 1
                both += m[: len(left)] @ m[len(left) :].T
            union = sizes[: len(left), None] + sizes[None, len(left) :] - both
            hit = (100 * both >= percent * union) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None])
            i, j = np.nonzero(hit)
            out = _forest(zip(left.id.to_numpy()[i].tolist(), right.id.to_numpy()[j].tolist()))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def classes_of(items: DataFrame) -> DataFrame:
    """(digest, id, n, sketch) of each class of items with equal, non-empty sets; id is the least."""
    live = items.filter("id IS NOT NULL AND n > 0")
    # equal sets have equal sizes and sketches, so any of a class will do
    return cut(live.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), release=True)


def linked(items: DataFrame, load_sets: Callable[[DataFrame], DataFrame], percent: int, rows: int = ROWS, judged: bool = True) -> DataFrame:
    """(id, component_id) of those of items (id, n, sketch), one for each class, that have links.

    Links: 100 * intersection >= percent * union; component_id is the smallest id reachable. Every pair that
    shares a band is either in one component already or compared on full sets; a pair at 0.85 shares none of 16 bands of
    4 with a probability of 8e-6, one at 0.8 with 3e-4. rows: registers of a band. judged: pairs that their sketches make hopeless
    are not compared on full sets; else n is not asked for.
    """
    hopeful = lambda pairs: _hopeful_pairs(pairs, items, percent / 100) if judged else pairs
    bands = _bands(items, rows)
    # the pivot is the least id under a scrambling of its own in every bucket
    low = F.min(F.col("id").bitwiseXOR(F.col("key")))
    pivots = bands.groupBy("key").agg(F.count("*").alias("size"), low.bitwiseXOR(F.col("key")).alias("pivot"))
    members = cut(bands.join(pivots.filter("size > 1"), "key"), release=True)
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    stars = members.filter("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).select(*pair)
    stars = cut(hopeful(stars.distinct()), release=True)
    # full sets only of those that a sketch leaves in question, or that share a bucket of three or more
    asked = stars.select(F.explode(F.array("a", "b")).alias("id")).union(members.filter("size > 2").select("id"))
    sets = cut(load_sets(asked.distinct()), release=True)
    first = components(cut(_confirmed(stars, sets, percent), release=True))

    named = members.filter("size > 2").join(first, "id", "left").withColumn("comp", F.coalesce("component_id", "id"))
    main = F.max(F.when(F.col("id") == F.col("pivot"), F.col("comp"))).alias("main")
    mixed = named.groupBy("key").agg(main, F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.filter("lo <> hi").select("key", "main")
    left = cut(named.join(mixed, "key").select("key", "id", "comp", "size", "pivot", "main"), release=True)
    small = left.filter((F.col("size") <= SMALL_BUCKET) & (F.col("id") != F.col("pivot")))
    x, y = (small.select("key", F.col("id").alias(i), F.col("comp").alias(c)) for i, c in (("x", "cx"), ("y", "cy")))
    near = x.join(y, "key").filter("x < y AND cx <> cy").select(*pair).distinct()
    found = _confirmed(hopeful(near), sets, percent)

    large = left.filter(F.col("size") > SMALL_BUCKET)
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    large = large.withColumn("of", n_blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    far = large.filter("comp <> main").select("key", "id", "comp", F.col("block").alias("i"), F.lit(0).alias("side"), others)
    far = far.withColumnRenamed("other", "j")
    # a row meets the blocks that hold rows outside the bucket's main component
    there = far.select("key", "i").distinct()
    near_side = large.join(there, "key").select("key", "id", "comp", "i", F.lit(1).alias("side"), F.col("block").alias("j"))
    cells = far.select("key", "id", "comp", "i", "side", "j").union(near_side).join(sets, "id")
    dense = cells.groupBy("key", "i", "j").applyInPandas(_cell_links(percent), "a long, b long")
    more = cut(found.union(dense), release=True)
    if more.isEmpty():
        return first
    # the further links join components, which are fewer than their members
    comp = lambda c: first.select(F.col("id").alias(c), F.col("component_id").alias(f"of_{c}"))
    joins = more.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    joins = joins.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    second = components(joins)
    over = second.select(F.col("id").alias("component_id"), F.col("component_id").alias("over"))
    inner = first.join(over, "component_id", "left").select("id", F.coalesce("over", "component_id").alias("component_id"))
    return inner.union(second.join(first, "id", "left_anti").select("id", "component_id"))


def similar_classes(items: DataFrame, load_sets: Callable[[DataFrame], DataFrame], percent: int, rows: int = ROWS) -> DataFrame:
    """(digest, component_id) of every class of items (id, n, digest, sketch) with equal, non-empty sets.

    Items that repeat an id with another set share its group; items with null ids or empty sets take no part.
    """
    classes = classes_of(items)
    groups = linked(classes.select("id", "n", "sketch"), load_sets, percent, rows)
    out = classes.select("digest", "id").join(groups, "id", "left")
    return out.select("digest", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text; other columns are ignored).

    A text's set holds its distinct k-word shingles; with fewer words its whole word sequence; without words none.
    Texts without words, null texts and rows with a null doc_id link with nothing and stay (component: own doc_id).
    Rows that repeat a doc_id share its group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hashes = HashKey()
    items = cut(sketch_texts(texts, k, hashes))
    groups = similar_classes(items, load_text_sets(texts, k, hashes), percent)
    out = items.select("id", "n", "digest").join(groups, "digest", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), comp).alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"),
    )
