"""Shared helpers: checkpoint folder, Arrow string access and byte-wise text hashing."""

import gc
import os
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster shares and names in spark.checkpoint.dir; one machine's own folder serves local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and cut its lineage.

    release: ask the driver's JVM to collect, upon which Spark's cleaner removes the shuffle files of steps whose frames are
    gone. They aren't needed once their result is in the shared folder, and would stay on the executors' disks for long.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if release:
        jvm = df.sparkSession.sparkContext._jvm
        del df
        gc.collect()
        jvm.System.gc()
    return out


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of whole texts with at most `limit` bytes each, or one longer text."""
    n, s = len(off) - 1, 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(off, off[s] + limit, side="right")) - 1)
        yield s, min(e, n)
        s = min(e, n)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Bytes of a span that are hashed in place; what follows goes through a keyed digest.
HASHED = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashKey:
    """The secret of one run's hashes. The driver draws it and tasks get it in their closures.

    Two lanes of NH, a universal hash over 32-bit halves, read the bytes: whatever two spans a text's author chooses,
    the chance over the key that both lanes agree is about 2^-64. Shingles are sums of word hashes with secret odd
    multipliers, a universal hash too.
    """

    def __init__(self):
        rng = np.random.default_rng(list(os.urandom(32)))
        draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
        self.halves = draw(HASHED // 4 + 2) & _LOW
        self.ends = draw(3) | np.uint64(1)
        self.shingle = draw(64) | np.uint64(1)
        self.secret = os.urandom(32)


def span_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: HashKey) -> np.ndarray:
    """64-bit hashes of spans of bytes, taken eight bytes at a time; a span's hash depends on its bytes and the key alone."""
    n = lengths.astype(np.uint64)
    a, b = n * key.ends[0], n * key.ends[1]
    if len(starts) == 0:
        return a
    words8, which, k = _eights(buf), slice(None), 0
    while True:
        w = words8[starts[which] + k] & _KEEP[np.minimum(lengths[which] - k, 8)]
        low, high, p = w & _LOW, w >> _HALF, key.halves[k // 4 :]
        a[which] += ((low + p[0]) & _LOW) * ((high + p[1]) & _LOW)
        b[which] += ((low + p[2]) & _LOW) * ((high + p[3]) & _LOW)
        k += 8
        which = np.flatnonzero(lengths > k)
        if not len(which):
            break
        if k >= HASHED:  # the few very long ones
            for i in which.tolist():
                rest = blake2b(buf[starts[i] + k : starts[i] + lengths[i]], digest_size=16, key=key.secret).digest()
                a[i] ^= np.uint64(int.from_bytes(rest[:8], "little"))
                b[i] ^= np.uint64(int.from_bytes(rest[8:], "little"))
            break
    return mix(mix(a) + b * key.ends[2])


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def same_spans(a: np.ndarray, at: np.ndarray, size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether spans of `a` have the same bytes as those of `b`, one by one."""
    same = size == b_size
    x, y, which, k = _eights(a), _eights(b), np.flatnonzero(same & (size > 0)), 0
    while len(which):
        differ = ((x[at[which] + k] ^ y[b_at[which] + k]) & _KEEP[np.minimum(size[which] - k, 8)]) != 0
        same[which[differ]] = False
        k += 8
        which = which[~differ]
        which = which[size[which] > k]
    return same


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(9, 14)]] = False
#: Bytes whose words are looked for at once.
STRETCH = 1 << 22


def word_places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and last bytes + 1 of the words (runs of bytes other than space and 09-0D) of texts in one buffer."""
    w = _WORD_BYTE[buf]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    heads = off[(off > 0) & (off < len(buf))]
    start[heads] = w[heads]
    end[heads - 1] = w[heads - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, off: np.ndarray, key: HashKey) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words: hashes with A-Z folded, first bytes, byte lengths, and the number of words up to each text's start."""
    first, end = word_places(buf, off)
    return span_hashes(_FOLD[buf], first, end - first, key), first, end - first, np.searchsorted(first, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, key: HashKey, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words(), and the number of words before each of `breaks` (the texts' bounds, if none are given).

    One very long text is read in stretches that end at a space, so that only hashes are held for all of its words.
    """
    breaks = off if breaks is None else breaks
    if len(buf) <= STRETCH or len(off) > 2:
        h, first, _, _ = words(buf, off, key)
        return h, np.searchsorted(first, breaks)
    parts, counts, at, n = [], [], 0, 0
    while at < len(buf):
        stop = min(at + STRETCH, len(buf))
        while stop < len(buf):
            gap = np.flatnonzero(~_WORD_BYTE[buf[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(stop + STRETCH, len(buf))
        h, first, _, _ = words(buf[at:stop], np.array([0, stop - at]), key)
        inside = breaks[(breaks >= at) & (breaks < stop)]
        counts.append(n + np.searchsorted(first, inside - at))
        parts.append(h)
        at, n = stop, n + len(h)
    counts.append(np.full(int((breaks >= len(buf)).sum()), n))
    return np.concatenate(parts), np.concatenate(counts)


def run_hashes(h: np.ndarray, k: int, key: HashKey) -> np.ndarray:
    """Hashes of all runs of k words, given at least k word hashes."""
    s = h[: len(h) - k + 1] * key.shingle[0]
    for j in range(1, k):
        s += h[j : len(h) - k + 1 + j] * key.shingle[j]
    return mix(s)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int, key: HashKey):
    """For each text, given its word hashes, the sorted distinct hashes of its k-word shingles.

    A text with 1 to k - 1 words has its whole sequence as the only shingle; without words its set is empty.
    """
    s = run_hashes(h, k, key) if len(h) >= k else None
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            v = np.sort(s[a : b - k + 1])
            yield v[np.append(True, v[1:] != v[:-1])] if len(v) > 1 else v
        elif b > a:
            part = h[a:b] * key.shingle[32 + b - a : 32 + 2 * (b - a)]
            yield mix(np.add.reduce(part, keepdims=True) + np.uint64(int(b - a)))
        else:
            yield np.zeros(0, np.uint64)


def doc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % modulus
