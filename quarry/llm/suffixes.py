"""Suffix-array dedup: windows of `threshold` bytes that also start in a document with a smaller doc_id are removed.

A depth-limited radix sort, most significant digit first, of which only the equal groups are wanted. Ordering all suffixes
would shuffle every byte's window, so each window is filed under its anchor, the place in it at which the hash of KEY
bytes is least: equal windows have equal anchors at equal offsets, and neighbouring windows share theirs (one anchor for
some 16 bytes). The digits are keyed 64-bit hashes of several bytes each:

  first digit   the anchor's KEY bytes. A group of one context, or one document, is done.
  second digit  the context, all bytes of the windows that share the anchor. All members of an equal group but those of its
                smallest document are repeats, windows and all.
  last digit    in groups of several contexts, the windows of each context's smallest document one by one.

Documents are dealt to blocks of some MB. A block sends a digit once however often it occurs there, so a digit that a
third of all documents have is one row a block, and gets one flag back for each; texts are shuffled once and read again
from that same shuffle. Blocks and buckets of digits are sized by the input.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HashKey, string_buffer

KEY = 20
#: Bytes of a text that are hashed at once.
STRIP = 1 << 18
#: Bytes of a block, for small and for large inputs, and the number of blocks from which on they grow.
LEAST_BLOCK, MOST_BLOCK, MANY = 2 << 20, 32 << 20, 4096
#: A first digit with more contexts than this in one block, or with two of different documents, goes on to its windows.
CONTEXTS = 8
_LOW40, _LOW32, _TOP = np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1), np.uint64(40)
REPEATED, LOOK = 1, 2


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = x * key
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def _spans(words: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int, keys: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of spans of at least eight bytes."""
    out = np.empty(len(start), np.uint64)
    for s in range(0, len(start), STRIP):
        a, e = start[s : s + STRIP], end[s : s + STRIP]
        h = _mix((e - a).astype(np.uint64) + keys[0], keys[1])
        for k in range(-(-longest // 8)):
            h = _mix(h ^ _mix(words[np.minimum(a + 8 * k, e - 8)] ^ keys[2], keys[3]), keys[4])
        out[s : s + STRIP] = h
    return out


def _anchors(buf: np.ndarray, off: np.ndarray, use: np.ndarray, size: int, keys: np.ndarray):
    """Of runs of windows with one anchor: hash of the anchor's bytes, its place, and the first and last window's start."""
    found: list = []
    wide, behind = size - KEY + 1, size + 8
    docs = [(a, e) for a, e, u in zip(off[:-1].tolist(), off[1:].tolist(), use.tolist()) if u and e - a >= size]
    k = 0
    for at in range(0, len(buf), STRIP):
        part = buf[at : at + STRIP + behind]
        part = np.concatenate([part, np.zeros(STRIP + behind - len(part), np.uint8)]) if len(part) < STRIP + behind else part
        begins = np.zeros(STRIP, bool)
        while k < len(docs) and docs[k][1] <= at:
            k += 1
        j = k
        while j < len(docs) and docs[j][0] < at + STRIP:
            begins[max(docs[j][0] - at, 0) : max(docs[j][1] - size + 1 - at, 0)] = True
            j += 1
        if not begins.any():
            continue
        m = _mix(_eights(part)[: STRIP + size] ^ keys[2], keys[3])
        n = STRIP + wide - 1
        h = _mix(m[:n] * keys[5] + m[8 : n + 8] * keys[6] + m[KEY - 8 : n + KEY - 8] * keys[7], keys[1])
        least = ((h >> np.uint64(20)) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
        have = 1
        while 2 * have <= wide:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < wide:
            least = np.minimum(least[: have - wide], least[wide - have :])
        i = np.flatnonzero(begins)
        p = (least[i] & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)))
        last = np.append(first[1:], len(i)) - 1
        found.append((h[p[first]], p[first] + at, i[first] + at, i[last] + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h, p, s, e = (np.concatenate(x) for x in zip(*found))
    new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != e[:-1] + 1))  # runs go on across strips
    last = np.append(np.flatnonzero(new)[1:], len(h)) - 1
    return h[new], p[new], s[new], e[last]


class _Block:
    """The digits of a block's documents, each once, in an order that depends on the set of documents alone."""

    def __init__(self, table: pa.Table, size: int, keys: np.ndarray, buckets: int):
        self.size, self.keys, self.buckets = size, keys, buckets
        self.buf, self.off = string_buffer(table["text"])
        ids = table["doc_id"].combine_chunks()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        h, p, s, e = _anchors(self.buf, self.off, self.known, size, keys)
        self.words = _eights(self.buf)
        doc = self.ids[np.searchsorted(self.off, s, side="right") - 1]
        c = _spans(self.words, s, e + size, 2 * size - KEY, keys[8:]) ^ _mix((p - s).astype(np.uint64) + keys[0], keys[5])
        a, b = (h & _LOW40) << np.uint64(24) | c >> _TOP, (c & _LOW32).astype(np.uint32)
        order = np.argsort(a)
        differ = np.diff(a[order]) == 0
        if (differ & ((np.diff(b[order]) != 0) | (np.diff(h[order]) != 0))).any():  # equal in the first 64 bits only
            order = np.lexsort((b, h, a))
        a, b, h = a[order], b[order], h[order]
        self.start, self.end, self.doc = s[order], e[order], doc[order]
        new = _changes(a, b, h)
        self.context = np.cumsum(new) - 1  # of each anchor
        self.heads = np.flatnonzero(new)
        self.low = np.minimum.reduceat(self.doc, self.heads) if len(h) else self.doc
        self.a, self.b, self.h = a[self.heads], b[self.heads], h[self.heads]
        # first digits with several contexts go on at once
        new = _changes(self.h)
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        several = np.diff(np.append(first, len(self.h)))
        if len(first):
            mixed = np.minimum.reduceat(self.low, first) != np.maximum.reduceat(np.maximum.reduceat(self.doc, self.heads), first)
            self.look = ((several > 1) & (mixed | (several > CONTEXTS)))[group]
        else:
            self.look = np.zeros(0, bool)
        # one entry for each context, or for all contexts of a first digit that goes on
        self.entry = np.flatnonzero(~self.look | new)
        self.bucket = ((self.h[self.entry] >> _TOP) % np.uint64(buckets)).astype(np.int64)
        self.dealt = self.entry[np.argsort(self.bucket, kind="stable")]
        self.bucket.sort()

    def digits(self):
        """(bucket, number, payload) of the entries of each bucket; a digit that goes on has all bits of its context set."""
        a, b = self.a[self.dealt].copy(), self.b[self.dealt].copy()
        on = self.look[self.dealt]
        a[on] |= np.uint64((1 << 24) - 1)
        b[on] = np.uint32(0xFFFFFFFF)
        for k, x, y in _runs(self.bucket):
            yield k, y - x, _packed(a[x:y], b[x:y], self.low[self.dealt[x:y]])

    def answered(self, answers: dict) -> None:
        """flags of each context, from {bucket: flags of its entries}."""
        self.flags = np.where(self.look, LOOK, 0).astype(np.uint8)
        for k, x, y in _runs(self.bucket):
            if k in answers:
                which = self.dealt[x:y]
                self.flags[which] |= np.where(self.look[which], 0, np.frombuffer(answers[k], np.uint8))

    def windows(self) -> None:
        """The windows of contexts to look into, once for each context, and their hashes."""
        wanted = np.flatnonzero((self.flags & LOOK) > 0)
        smallest = np.flatnonzero(self.doc == self.low[self.context])
        one = np.zeros(len(self.heads), np.int64)
        one[self.context[smallest]] = smallest  # any member of the smallest document
        many = (self.end - self.start)[one[wanted]] + 1
        self.first = np.zeros(len(self.heads), np.int64)  # of each context among the windows
        self.first[wanted] = np.cumsum(many) - many
        begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[one[wanted]], many)
        self.window_doc = np.repeat(self.low[wanted], many)
        h = _spans(self.words, begin, begin + self.size, self.size, self.keys[16:])
        order = np.argsort(h)
        new = _changes(h[order])
        self.window = np.empty(len(h), np.int64)
        self.window[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.window_hash = h[order][heads]
        self.window_low = np.minimum.reduceat(self.window_doc[order], heads) if len(h) else self.window_doc
        bucket = ((self.window_hash >> _TOP) % np.uint64(self.buckets)).astype(np.int64)
        self.window_dealt = np.argsort(bucket, kind="stable")
        self.window_bucket = bucket[self.window_dealt]

    def last_digits(self):
        for k, x, y in _runs(self.window_bucket):
            which = self.window_dealt[x:y]
            yield k, y - x, _packed(self.window_hash[which], None, self.window_low[which])

    def removed(self, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts + 1 of runs of windows to be removed."""
        smaller = np.zeros(len(self.window_hash), bool)
        for k, x, y in _runs(self.window_bucket):
            if k in answers:
                smaller[self.window_dealt[x:y]] = np.frombuffer(answers[k], np.uint8) > 0
        gone = smaller[self.window] | (self.window_doc > self.window_low[self.window]) if len(self.window) else np.zeros(0, bool)
        whole = (self.doc > self.low[self.context]) | ((self.flags & REPEATED) > 0)[self.context]
        starts, ends = [self.start[whole]], [self.end[whole] + 1]
        look = np.flatnonzero(~whole & ((self.flags & LOOK) > 0)[self.context])
        many = (self.end - self.start)[look] + 1
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hit = gone[np.repeat(self.first[self.context[look]], many) + offset]
        begin = (np.repeat(self.start[look], many) + offset)[hit]
        return np.concatenate([*starts, begin]), np.concatenate([*ends, begin + 1])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _runs(sorted_keys: np.ndarray):
    first = np.flatnonzero(_changes(sorted_keys))
    yield from zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist())


def _packed(a: np.ndarray, b: np.ndarray | None, doc: np.ndarray) -> bytes:
    small = len(doc) and doc.min() >= 0 and doc.max() < 1 << 32
    return a.tobytes() + (b"" if b is None else b.tobytes()) + doc.astype(np.uint32 if small else np.int64).tobytes()


def _unpacked(payload: bytes, n: int, with_b: bool):
    fixed = 12 if with_b else 8
    doc = np.frombuffer(payload, np.uint32 if len(payload) == n * (fixed + 4) else np.int64, n, fixed * n).astype(np.int64)
    return np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.uint32, n, 8 * n) if with_b else None, doc


_SENT, _ANSWER = "bucket long, blk long, n long, payload binary", "blk long, kind long, bucket long, flags binary"


def _table(schema: list, rows: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[name for name, _ in schema])


_SENT_ARROW = [("bucket", pa.int64()), ("blk", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]
_ANSWER_ARROW = [("blk", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary())]


def _answers(bucket, blks: list, ns: list, flags: np.ndarray, kind: int) -> pa.Table:
    cuts, rows = np.append(0, np.cumsum(ns)), []
    for k, blk in enumerate(blks):
        part = flags[cuts[k] : cuts[k + 1]]
        if part.any():
            rows.append((blk, kind, bucket, part.tobytes()))
    return _table(_ANSWER_ARROW, rows)


def _judge_contexts(t: pa.Table) -> pa.Table:
    """Flags of the entries of one bucket of first and second digits."""
    blks, ns = t["blk"].to_pylist(), t["n"].to_pylist()
    a, b, doc = (np.concatenate(x) for x in zip(*(_unpacked(p.as_py(), n, True) for p, n in zip(t["payload"], ns))))
    order = np.lexsort((doc, b, a))
    sa, sb, sd = a[order], b[order], doc[order]
    new = _changes(sa, sb)
    context, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    low = sd[heads]
    goes_on = ((sa[heads] & np.uint64((1 << 24) - 1)) == np.uint64((1 << 24) - 1)) & (sb[heads] == np.uint32(0xFFFFFFFF))
    starts = _changes(sa[heads] >> np.uint64(24))
    digit, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
    several = np.diff(np.append(first, len(heads))) > 1
    mixed = np.minimum.reduceat(low, first) != np.maximum.reduceat(np.maximum.reduceat(sd, heads), first)
    look = ((several & mixed) | np.logical_or.reduceat(goes_on, first))[digit]
    flags = np.empty(len(a), np.uint8)
    repeated = sd > low[context]
    flags[order] = np.where(repeated, REPEATED, np.where(look[context], LOOK, 0)).astype(np.uint8)
    return _answers(t["bucket"][0].as_py(), blks, ns, flags, 0)


def _judge_windows(t: pa.Table) -> pa.Table:
    """Which entries of one bucket of last digits are also in a smaller document."""
    blks, ns = t["blk"].to_pylist(), t["n"].to_pylist()
    a, _, doc = zip(*(_unpacked(p.as_py(), n, False) for p, n in zip(t["payload"], ns)))
    a, doc = np.concatenate(a), np.concatenate(doc)
    order = np.argsort(a)
    new = _changes(a[order])
    low = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    flags = np.empty(len(a), np.uint8)
    flags[order] = doc[order] > low[np.cumsum(new) - 1]
    return _answers(t["bucket"][0].as_py(), blks, ns, flags, 1)


def _of_kind(answers: pa.Table, kind: int) -> dict:
    return {b: f for k, b, f in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["flags"].to_pylist()) if k == kind}


def _cleaned(one: _Block, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """The rows of a block without the windows that start in [start, end)."""
    order = np.argsort(start)
    start, end = start[order], end[order] - 1 + one.size
    reach, doc = np.maximum.accumulate(end) if len(end) else end, np.searchsorted(one.off, start, side="right") - 1
    new = np.append(True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))[: len(start)]
    heads = np.flatnonzero(new)
    start, doc = start[heads], doc[heads]
    end = np.maximum.reduceat(end, heads) if len(heads) else end
    step = np.zeros(len(one.buf) + 1, np.int8)
    step[start] += 1
    np.add.at(step, end, -1)
    gone = np.cumsum(step[:-1], dtype=np.int8) > 0
    before = np.append(0, np.cumsum(end - start))
    upto = np.searchsorted(doc, np.arange(len(one.off)))
    kept = pa.Array.from_buffers(pa.large_binary(), len(one.ids), [None, pa.py_buffer(np.ascontiguousarray(one.off - before[upto]).astype(np.int64)), pa.py_buffer(one.buf[~gone])])
    spans = pa.StructArray.from_arrays([pa.array(start - one.off[doc]), pa.array(end - one.off[doc])], ["start", "end"])
    columns = [pa.array(one.ids, mask=~one.known), pa.array(np.diff(one.off)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spans), kept.cast(pa.binary())]
    return pa.table(columns, names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, threshold: int = 50, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) of every row; spans are maximal removed runs of bytes.

    A byte goes if a window of `threshold` equal bytes that covers it also starts in a row with a smaller doc_id; windows are
    judged on the input. Null texts count as empty. Rows that repeat a doc_id are no smaller than each other. A row with a
    null doc_id is neither smaller nor larger than any: it stays whole and takes nothing from others. Other columns are
    ignored. threshold must be at least 2 * KEY.
    """
    if threshold < 2 * KEY:
        raise ValueError(f"threshold must be at least {2 * KEY}")
    keys = HashKey().shingle
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // min(max(LEAST_BLOCK, total // MANY), MOST_BLOCK)))
    # dealt by place, so that one doc_id of very many rows is no hot key
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def scan(t: pa.Table) -> _Block:
        return _Block(t, threshold, keys, blocks)

    def first(t: pa.Table) -> pa.Table:
        blk = t["blk"][0].as_py()
        return _table(_SENT_ARROW, [(k, blk, n, p) for k, n, p in scan(t).digits()])

    def last(t: pa.Table, answers: pa.Table) -> pa.Table:
        one, blk = scan(t), t["blk"][0].as_py()
        one.answered(_of_kind(answers, 0))
        one.windows()
        return _table(_SENT_ARROW, [(k, blk, n, p) for k, n, p in one.last_digits()])

    def cleaned(t: pa.Table, answers: pa.Table) -> pa.Table:
        one = scan(t)
        one.answered(_of_kind(answers, 0))
        one.windows()
        return _cleaned(one, *one.removed(_of_kind(answers, 1)))

    by_block = rows.groupBy("blk")
    contexts = by_block.applyInArrow(first, _SENT).groupBy("bucket").applyInArrow(_judge_contexts, _ANSWER)
    windows = by_block.cogroup(contexts.groupBy("blk")).applyInArrow(last, _SENT).groupBy("bucket").applyInArrow(_judge_windows, _ANSWER)
    return by_block.cogroup(contexts.union(windows).groupBy("blk")).applyInArrow(cleaned, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_bytes(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """Counts and digests of remove_repeats()."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return remove_repeats(docs, threshold).select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
