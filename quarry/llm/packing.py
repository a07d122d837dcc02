"""Packing of tokenized documents into fixed windows by minimum bin slack.

A document is cut into whole windows and one shorter rest. The rests' lengths are counted (at most one count for each
length below the window); a planner then repeats: take the longest length left, find by bitset subset-sum dynamic
programming the multiset of remaining lengths that fills the window closest to capacity, and use it as often as the
counts allow. The plan is as small as the window, however many documents there are; pieces find their places in it
by their rank among those of the same length, counted in salted buckets.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import crc32_ids, encoded
from quarry.llm.common import cut

#: Rows of one length in one bucket, about.
BUCKET_ROWS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Windows and rests of each text's ids with end_id after them."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def emit(doc_ids, n_bytes, n, ids):
        out = ([], [], [], [], [], [])
        for doc, x in zip(doc_ids.to_pylist(), ids):
            x = np.append(x, np.uint32(end_id))
            for s in range(0, len(x), window):
                part = x[s : s + window]
                for column, value in zip(out, (doc, s, len(part), crc32_ids(part), len(x))):
                    column.append(value)
                if with_ids:
                    out[5].append(part.astype(np.int64))
        columns = [pa.array(x, pa.int64()) for x in out[:5]]
        if with_ids:
            return pa.RecordBatch.from_arrays([*columns, pa.array(out[5], pa.list_(pa.int64()))], [*names, "token_ids"])
        return pa.RecordBatch.from_arrays(columns, names)

    return encoded(docs, path, True, emit, PIECES + ", token_ids array<long>" * with_ids)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths at hand, the multiset with the largest sum not above room."""
    items = []
    for length in sorted(counts, reverse=True):
        n, size = min(counts[length], room // length), 1
        while n > 0:
            items.append((length, min(size, n)))
            n, size = n - size, 2 * size
    reach, mask = [1], (1 << room + 1) - 1
    for length, n in items:
        reach.append((reach[-1] | reach[-1] << length * n) & mask)
        if reach[-1] >> room & 1:
            break
    left, fill = reach[-1].bit_length() - 1, {}
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> left & 1:
            length, n = items[i - 1]
            fill[length] = fill.get(length, 0) + n
            left -= length * n
    return fill


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: how often in the sequence) with the number of sequences that use each."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        first = max(left)
        rest = {k: n - (k == first) for k, n in left.items() if n > (k == first) and k <= window - first}
        fill = best_fill(rest, window - first)
        pattern = {first: 1}
        for k, n in fill.items():
            pattern[k] = pattern.get(k, 0) + n
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times in a sequence, first sequence, offset of its first copy)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for k, n in pattern.items():
            rows.setdefault(k, []).append((used.get(k, 0), n, sequence, offset))
            used[k] = used.get(k, 0) + n * times
            offset += k * n
        sequence += times
    return {k: np.array(x, np.int64) for k, x in rows.items()}


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text; other columns are ignored) with sequence_id and offset (gapless from 0).

    A null or empty text is the one token end_id. Every row of docs is packed, also those that repeat a doc_id or
    have none. No sequence is longer than window.
    """
    cutted = cut(pieces(docs, path, window, end_id, with_ids))
    buckets = max(1, min(4096, -(-cutted.count() // BUCKET_ROWS)))
    cutted = cutted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sums = cut(cutted.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(counts, window))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    first = sums.select("length", "bucket", before.alias("first"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cutted.withColumn("rank", F.row_number().over(order) - 1).join(first, ["length", "bucket"])
    names = [x.split()[0] for x in PIECES.split(", ")] + ["token_ids"] * with_ids

    def run(batches):
        for b in batches:
            rank = b.column("rank").to_numpy() + b.column("first").to_numpy()
            length = b.column("length").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for k in np.unique(length):
                i = np.flatnonzero(length == k)
                start, n, s, o = places[int(k)][np.searchsorted(places[int(k)][:, 0], rank[i], side="right") - 1].T
                sequence[i], offset[i] = s + (rank[i] - start) // n, o + (rank[i] - start) % n * k
            columns = [b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = PIECES + ", token_ids array<long>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank", "first").mapInArrow(run, schema)
