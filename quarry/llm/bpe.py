"""Byte-level BPE over whole Arrow batches: vectorised pre-tokenising, cached encoding of distinct pre-tokens.

The pre-token rules are those of `public_tokenizers.PATTERN`: contractions ('s 't 're 've 'm 'll 'd), runs of
letters, of numbers or of other characters with one optional space before, and white space. They are local, so
boundaries follow from character classes of neighbours; a batch's distinct pre-tokens are encoded once.

Texts are taken as overlapping chunks of CHUNK_BYTES, a short one as one chunk. Each is pre-tokenised by itself; boundaries
depend on the closest neighbours only, so within the overlap a chunk's list agrees again with its predecessor's, and
pre-tokens are encoded once the lists are stitched. A text of more than CHUNK_CHARS characters is dealt out as rows of such chunks
over all tasks; there what lies across a seam (from a chunk's last boundary to the next one's first) is encoded in stitching.
"""

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HASHED, HashKey, blocks, same_spans, span_hashes, string_buffer
from quarry.llm.merges import Merges
from quarry.llm.transducer import CountingTransducer

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)  # BLANK is U+0020 alone
#: Pre-tokens, and bytes of pre-tokens and ids, that a worker remembers before it starts afresh.
CACHE, CACHE_BYTES = 800_000, 96 << 20
#: Characters of a chunk of a long text, and of the overlap before and after it.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 18, 64
#: The same in bytes for chunks of one batch.
CHUNK_BYTES, OVERLAP_BYTES = 1 << 13, 256


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000)).tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[0x20] = BLANK
    return table


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.uint32)
    if len(at) != len(buf):
        tail = np.append(buf, np.zeros(4, np.uint8)).astype(np.uint32) & 0x3F
        for low, high, n, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
            i = np.flatnonzero((cp >= low) & (cp < high) & (buf[at] >= low))
            v = cp[i] & mask
            for k in range(1, n + 1):
                v = (v << 6) | tail[at[i] + k]
            cp[i] = np.minimum(v, 0x10FFFF)
    return cp, at


def char_facts(cp: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: its class, whether a non-space follows in its text, and the letters of a contraction that may begin here.

    new marks the first character of each text.
    """
    cls = class_table()[cp]
    n = len(cp)
    joined = np.zeros(n, bool)
    joined[:-1] = ~new[1:]
    follows = np.zeros(n, bool)
    follows[:-1] = (cls[1:] < SPACE) & joined[:-1]
    reach = np.zeros(n, np.uint8)
    q = np.flatnonzero((cp == 0x27) & follows)
    if len(q):
        a = cp[q + 1]
        b = np.append(cp, 0)[np.minimum(q + 2, n)]
        b = np.where(joined[q + 1], b, 0)
        two = ((a == 0x6C) & (b == 0x6C)) | (((a == 0x76) | (a == 0x72)) & (b == 0x65))
        reach[q[np.isin(a, [0x73, 0x64, 0x6D, 0x74])]] = 1
        reach[q[two]] = 2
    return cls, follows, reach


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    cls = class_table()[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        tail = np.append(buf, np.zeros(4, np.uint8)).astype(np.uint32)
        b = tail[lead]
        n = 1 + (b >= 0xE0) + (b >= 0xF0)
        cp = b & np.array([0, 0x1F, 0x0F, 0x07], np.uint32)[n]
        padded = np.append(cls, np.zeros(4, np.uint8))
        for k in (1, 2, 3):
            m = n >= k
            cp[m] = (cp[m] << 6) | (tail[lead[m] + k] & 0x3F)
        c = class_table()[np.minimum(cp, 0x10FFFF)]
        for k in (0, 1, 2, 3):
            m = n >= k
            padded[lead[m] + k] = c[m]
        cls = padded[: len(cls)]
    return cls


def pretoken_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of texts that lie back to back in buf; a text's first byte always is one."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    heads = np.unique(off[:-1][off[1:] > off[:-1]])
    before = np.empty_like(cls)
    before[1:], before[heads] = cls[:-1], 255
    space = cls >= SPACE
    follows = np.zeros(n, bool)  # a character other than white space comes next in this text
    follows[:-1] = ~space[1:]
    follows[heads[1:] - 1] = False
    start = np.where(space, follows | (before < SPACE) | (before == 255), (before != cls) & (before != BLANK))
    wide = np.flatnonzero(space & (buf >= 0x80))
    if len(wide):  # white space of several bytes: only its first byte may begin a pre-token, by what follows its last
        first = wide[buf[wide] >= 0xC0]
        size = 2 + (buf[first] >= 0xE0)
        start[wide] = False
        ok = follows[np.minimum(first + size - 1, n - 1)]
        start[first] = ok | (before[first] < SPACE) | (before[first] == 255)
    q = np.flatnonzero((buf == 0x27) & start & follows)
    if len(q):
        padded = np.append(buf, np.zeros(2, np.uint8))
        third = padded[q + 2] * (np.append(follows, False)[q + 1])
        second = padded[q + 1]
        two = ((second == 0x6C) & (third == 0x6C)) | (((second == 0x76) | (second == 0x72)) & (third == 0x65))
        reach = np.where(np.isin(second, [0x73, 0x64, 0x6D, 0x74]), 1, np.where(two, 2, 0))
        q, reach = q[reach > 0], reach[reach > 0]
        start[q + 1] = False
        end = q + 1 + reach
        is_head = np.zeros(n + 1, bool)
        is_head[heads] = True
        more = end[end < n]
        start[more[(cls[more] == LETTER) & ~is_head[more]]] = True
    start[heads] = True
    return np.flatnonzero(start)


def _at_characters(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places moved back to the first byte of the character they are in."""
    places = places.copy()
    for _ in range(3):
        inside = (places < len(buf)) & (places > 0)
        places[inside] -= (buf[places[inside]] & 0xC0) == 0x80
    return places


def stitched_starts(buf: np.ndarray, off: np.ndarray, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> np.ndarray:
    """pretoken_starts() of texts taken as overlapping chunks of `size` bytes; a short text is one.

    Each chunk is pre-tokenised by itself. Its first boundaries may be its edge's own, but boundaries depend on the nearest
    neighbours, so they agree with the predecessor's before the overlap ends: a chunk's boundaries count from where it begins
    without the overlap up to where the next one does.
    """
    n = np.diff(off)
    many = np.maximum(-(-n // size), 1)
    if (many <= 1).all():
        return pretoken_starts(buf, off)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    low = np.where(k == 0, off[:-1][text], _at_characters(buf, off[:-1][text] + k * size))
    high = np.where(k + 1 == many[text], off[1:][text], np.append(low[1:], len(buf)))
    first = _at_characters(buf, np.maximum(low - overlap, off[:-1][text]))
    last = _at_characters(buf, np.minimum(high + overlap, off[1:][text]))
    ends = np.append(0, np.cumsum(last - first))
    starts = pretoken_starts(np.concatenate([buf[a:b] for a, b in zip(first, last)]), ends)
    chunk = np.searchsorted(ends, starts, side="right") - 1
    starts = starts - ends[chunk] + first[chunk]
    return starts[(starts >= low[chunk]) & (starts < high[chunk])]


class PieceCache:
    """What was worked out for the pre-tokens met so far. A hash finds the entry and the bytes confirm it.

    work: (ids of all given pre-tokens in a row, how many each has); for counts alone, no ids.
    """

    def __init__(self, work: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.work, self.key = work, HashKey()
        self.reset()

    def reset(self) -> None:
        self.keys, self.ids, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.slots, self.at, self.n, self.pool_at, self.size = (np.zeros(0, np.int32) for _ in range(5))  # CACHE_BYTES keeps them small

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        ids, n = self.work(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        slots = np.arange(len(self.n), len(self.n) + len(n))
        more = lambda old, new: np.concatenate([old, new.astype(old.dtype)])
        self.at, self.n, self.ids = more(self.at, len(self.ids) + np.cumsum(n) - n), more(self.n, n), more(self.ids, ids)
        self.pool_at, self.size = more(self.pool_at, len(self.pool) + np.cumsum(size) - size), more(self.size, size)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(pieces), np.uint8)])
        return slots

    def slots_of(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entry of every pre-token of a buffer. Until the next call, self.n and self.ids hold what belongs to it."""
        if len(self.n) > CACHE or len(self.pool) + 4 * len(self.ids) > CACHE_BYTES:
            self.reset()
        ends = np.append(starts[1:], len(buf))
        lengths = ends - starts
        slot = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(lengths <= HASHED)
        if len(short):
            begin, size = starts[short], lengths[short]
            keys, index, inverse = np.unique(span_hashes(buf, begin, size, self.key), return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            new = np.append(self.keys, np.uint64(0))[place] != keys
            new |= place >= len(self.keys)
            if new.any():
                i = short[index[new]]
                added = self._add([buf[a:b].tobytes() for a, b in zip(starts[i].tolist(), ends[i].tolist())])
                self.keys, self.slots = np.insert(self.keys, place[new], keys[new]), np.insert(self.slots, place[new], added)
                place = np.searchsorted(self.keys, keys)
            found = self.slots[place][inverse]
            same = same_spans(buf, begin, size, self.pool, self.pool_at[found], self.size[found])
            slot[short[same]] = found[same]
        # very long ones, and those that share a hash with others
        odd = np.flatnonzero(slot < 0)
        if len(odd):
            slot[odd] = self._add([buf[a:b].tobytes() for a, b in zip(starts[odd].tolist(), ends[odd].tolist())])
        return slot


class Vocabulary:
    """A vocabulary file with its merges, the transducer compiled from them, and the caches of both."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = self.merges.special
        self.bytes = np.frombuffer(b"".join(self.merges.piece), np.uint8)
        self.lengths = np.array(self.merges.size, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.encoded, self.counted = PieceCache(self.encode_pieces), PieceCache(self.count_pieces)

    @cached_property
    def transducer(self) -> CountingTransducer:
        return CountingTransducer(self.merges)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long = [k for k, p in enumerate(pieces) if len(p) > HASHED]
        ids, bounds = self.merges.encode([b"" if len(p) > HASHED else p for p in pieces])
        n = np.diff(bounds)
        if long:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for k in long:  # rounds over all places would take too long for these
                parts[k] = np.array(self.transducer.tokens(pieces[k]), np.int64)
                n[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, n

    def count_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(self.transducer.count, pieces), np.int64, len(pieces))
        return np.zeros(0, np.uint32), n

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts back to back, and each text's first id (n + 1 places)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts, cache = stitched_starts(buf, off), self.encoded
        slot = cache.slots_of(buf, starts)
        n = cache.n[slot]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(cache.at[slot] - (ends - n), n)
        return cache.ids[at], np.append(0, ends)[np.searchsorted(starts, off)]

    def segments(self, data: bytes) -> list[bytes | int]:
        """A text cut at the special tokens' strings, which stand as their ids."""
        out: list[bytes | int] = []
        for x in regex.split(b"(" + b"|".join(map(regex.escape, self.special)) + b")", data):
            if x:
                out.append(self.special.get(x, x))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' raw bytes, concatenated."""
        out = []
        for s in range(0, len(ids), 1 << 18):
            part = ids[s : s + (1 << 18)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.arange(int(ends[-1])) + np.repeat(self.first[part] - (ends - n), n)].tobytes())
        return b"".join(out)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(column: pa.Array, path: str, special: bool) -> Iterator[np.ndarray]:
    """Ids (uint32) of each text of an Arrow column; special strings become their ids if special, else ordinary text."""
    v = vocabulary(path)
    buf, off = string_buffer(column)
    for s, e in blocks(off):
        part, at = buf[off[s] : off[e]], off[s : e + 1] - off[s]
        data = part.tobytes() if special and v.special else b""
        if any(w in data for w in v.special):
            for a, b in zip(at[:-1], at[1:]):
                found = [np.zeros(0, np.uint32)]
                for x in v.segments(data[a:b]):
                    seg = np.frombuffer(x, np.uint8) if isinstance(x, bytes) else None
                    found.append(np.array([x], np.uint32) if seg is None else v.encode(seg, np.array([0, len(seg)]))[0])
                yield np.concatenate(found)
            continue
        ids, first = v.encode(part, at)
        for a, b in zip(first[:-1], first[1:]):
            yield ids[a:b]


CHUNKS = "row long, doc_id long, segment int, chunk int, mark string, n_bytes long, begun boolean, head binary, n long, ids binary, tail binary"


def chunk_rows(texts: DataFrame, path: str, special: bool, with_ids: bool, chars: int) -> DataFrame:
    """CHUNKS of texts (doc_id, text): pre-tokens that lie whole in a chunk are encoded, or counted; its ends stay bytes.

    head: up to the chunk's first boundary, tail: from its last one on. Special strings end a segment and are its mark.
    """
    marks = vocabulary(path).special if special else {}
    pattern = "|".join(re.escape(w.decode()) for w in marks) or "(?!)"
    cut = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", pattern, -1).alias("part"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("marks"))
    cut = cut.select("row", "doc_id", "marks", F.posexplode("part").alias("segment", "part")).withColumn("mark", F.get("marks", F.col("segment")))
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("part") / chars).cast("int") - 1))
    cut = cut.select("row", "doc_id", "segment", "mark", "part", F.explode(pieces).alias("chunk"))
    at = F.col("chunk") * chars
    before = F.least(at, F.lit(OVERLAP_CHARS))
    sub = lambda a, n: F.substr("part", (a + 1).cast("int"), n)
    cut = cut.select(
        "row", "doc_id", "segment", "chunk", "mark", sub(at - before, before).alias("before"), sub(at, F.lit(chars)).alias("own"), sub(at + chars, F.lit(OVERLAP_CHARS)).alias("after")
    ).repartition("row", "segment", "chunk")

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            rows = []
            for before, own, after, mark, chunk in zip(*(b.column(c).to_pylist() for c in ("before", "own", "after", "mark", "chunk"))):
                before, own = before.encode(), own.encode()
                size = len(own) + (len(mark.encode()) if mark is not None and chunk == 0 else 0)
                buf = np.frombuffer(before + own + after.encode(), np.uint8)
                starts = pretoken_starts(buf, np.array([0, len(buf)]))
                low, high = len(before), len(before) + len(own)
                starts = starts[(starts >= low) & (starts < high)]
                if not len(starts):
                    rows.append((size, False, own, 0, b"", b""))
                    continue
                # the last pre-token may go on in the next chunk
                whole = buf[starts[0] : starts[-1]]
                ids = n = np.zeros(0, np.uint32)
                if len(whole):
                    cache = v.encoded if with_ids else v.counted
                    slot = cache.slots_of(whole, starts[:-1] - starts[0])
                    n = cache.n[slot]
                    ends = np.cumsum(n)
                    ids = cache.ids[np.arange(int(ends[-1])) + np.repeat(cache.at[slot] - (ends - n), n)] if with_ids else ids
                rows.append((size, True, buf[low : starts[0]].tobytes(), int(n.sum()), ids.astype("<u4").tobytes(), buf[starts[-1] : high].tobytes()))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            more = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:5]] + more, names)

    return cut.mapInArrow(run, CHUNKS)


def _stitched(chunks: list[dict], v: Vocabulary, with_ids: bool) -> tuple[int, np.ndarray]:
    """The number of ids of one text, and the ids, of its chunks in order."""
    out, n, open_ = [np.zeros(0, np.uint32)], 0, []

    def close():
        nonlocal n
        piece = b"".join(open_)
        open_.clear()
        if piece:
            if with_ids:
                out.append(v.encode_pieces([piece])[0].astype(np.uint32))
                n += len(out[-1])
            else:
                n += v.transducer.count(piece)

    for k, c in enumerate(chunks):
        open_.append(c["head"])
        if c["begun"]:
            close()
            out.append(np.frombuffer(c["ids"], "<u4"))
            n += c["n"]
            open_.append(c["tail"])
        if k + 1 == len(chunks) or chunks[k + 1]["segment"] != c["segment"]:
            close()
            if c["mark"] is not None:
                out.append(np.array([v.special[c["mark"].encode()]], np.uint32))
                n += 1
    return n, np.concatenate(out)


def encoded(docs: DataFrame, path: str, special: bool, emit: Callable, schema: str, count: Callable | None = None, chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows that emit(doc_ids, n_bytes, n_tokens, ids) makes of all texts, in batches. Null texts are empty.

    Short texts are encoded where they are read. Those of more than `chars` characters, which are few, are dealt out as
    rows of chunks over all tasks and stitched. With count(texts), tokens are counted and there are no ids.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > chars, F.lit(False))

    def short(batches):
        for b in batches:
            off = string_buffer(b.column("text"))[1]
            if count is not None:
                yield emit(b.column("doc_id"), np.diff(off), count(b.column("text")), None)
                continue
            for s, e in blocks(off):  # ids of one block at a time, whatever a batch holds
                part = b.slice(s, e - s)
                ids = list(encode_texts(part.column("text"), path, special))
                yield emit(part.column("doc_id"), np.diff(off[s : e + 1]), np.array([len(x) for x in ids], np.int64), ids)

    def long(batches):
        v = vocabulary(path)
        for b in batches:
            for doc_id, size, chunks in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("chunks").to_pylist()):
                n, ids = _stitched(chunks, v, count is None)
                yield emit(pa.array([doc_id], pa.int64()), np.array([size]), np.array([n]), [ids] if count is None else None)

    rows = chunk_rows(texts.filter(is_long), path, special, count is None, chars)
    fields = F.struct("segment", "chunk", "mark", "begun", "head", "n", "ids", "tail")
    joined = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(fields)).alias("chunks"))
    return texts.filter(~is_long).mapInArrow(short, schema).union(joined.select("doc_id", "n_bytes", "chunks").mapInArrow(long, schema))


def encode_decode(docs: DataFrame, path: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, token_ids, decoded) of docs (doc_id, text): ids by the ranks at `path`, and the bytes they decode to.

    Null and empty texts have no ids. One row for every row of docs; other columns are ignored.
    """

    def emit(doc_ids, n_bytes, n, ids):
        v = vocabulary(path)
        tokens = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([doc_ids, tokens, pa.array([v.decode(x) for x in ids], pa.binary())], ["doc_id", "token_ids", "decoded"])

    return encoded(docs, path, False, emit, "doc_id long, token_ids array<long>, decoded binary", chars=chars)


def encoding_digests(docs: DataFrame, path: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_decode with its long columns digested where they are made."""

    def emit(doc_ids, n_bytes, n, ids):
        v = vocabulary(path)
        digests = [[sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [sha256(v.decode(x)).hexdigest() for x in ids]]
        columns = [doc_ids, pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in digests)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, path, False, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chars=chars)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
