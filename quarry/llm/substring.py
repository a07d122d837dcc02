"""Repeated passages: stretches of words of different documents that are equal or nearly so.

A paragraph is a line of MIN_WORDS words or more. Bands of SetSketch registers
over its 5-word shingles, tuned for recall, bring paragraphs together; exact Jaccard similarities confirm them;
components are clusters, and all but the first paragraph of a cluster (by doc_id and place) are removed.

Passages inside or across paragraphs: a run of RUN words is an anchor where its hash is the least of WINDOW runs in a
row, so equal stretches of RUN + WINDOW - 1 = 49 words share an anchor wherever they begin. All but the first place of an
anchor are copies; copies that touch are one passage, confirmed word by word and drawn out at its ends as far as the words
go on equal, which gives the longest common stretch.

Places are counted in words of the text: passages don't depend on white space or on the case of A-Z.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import HashKey, blocks, cut, mix, run_hashes, shingle_sets, string_buffer, word_hashes, word_places
from quarry.llm.minhash import linked, sketches

#: The least words of a passage.
MIN_WORDS = 25
#: Unrelated paragraphs share few shingles, so short bands do: a pair at 0.8 meets in one of eight with a probability of 0.997.
BANDS, ROWS = 8, 3
#: Words of an anchor, and runs of which the one with the least hash is one.
RUN, WINDOW = 16, 34
#: Words beside the outer anchors to which an equal stretch can go on: with WINDOW of them there would be another anchor.
REACH = WINDOW - 1

_PARAGRAPH = np.dtype([("at", "<i4"), ("n", "<i4"), ("digest", "V16"), ("sketch", f"V{2 * BANDS * ROWS}")])
_ANCHOR = np.dtype([("h", "<i8"), ("at", "<i4")])


def _digests(h: np.ndarray, begin: np.ndarray, n: np.ndarray, key: HashKey) -> np.ndarray:
    """(len(begin), 2): keyed 128-bit digests of stretches of word hashes: sums with a secret multiplier for each place."""
    out = np.zeros((len(begin), 2), np.uint64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    x, first = h[np.repeat(begin, n) + place], np.cumsum(n) - n
    for lane in (0, 1):
        by = mix(place.astype(np.uint64) * key.ends[lane] + key.shingle[lane]) | np.uint64(1)
        out[:, lane] = mix(np.add.reduceat(x * by, first) + n.astype(np.uint64) * key.ends[2])
    return out


def _lines(line_at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first word, words) of a text's paragraphs, given the word numbers at which its lines begin and the last ends."""
    n = np.diff(line_at)
    some = n >= least
    return list(zip(line_at[:-1][some].tolist(), n[some].tolist()))


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minima (or maxima) of each `width` values in a row."""
    best, have = np.minimum if least else np.maximum, 1
    while have < width:
        step = min(have, width - have)
        x, have = best(x[:-step], x[step:]), have + step
    return x


def _chosen(g: np.ndarray) -> np.ndarray:
    """Places of the anchors among a text's run hashes; of equal runs that overlap each other, the first."""
    width = min(WINDOW, len(g))
    low = _slide(g, width, True)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, False) == g)
    if len(np.unique(g[at])) < len(at):
        last, keep = {}, []
        for p, x in zip(at.tolist(), g[at].tolist()):
            if p - last.get(x, -RUN) >= RUN:
                last[x] = p
                keep.append(p)
        at = np.array(keep, np.int64)
    return at


def _units(texts: DataFrame, key: HashKey, min_words: int, k: int) -> DataFrame:
    """(doc_id, anchors, paragraphs) of every text, both packed: one reading of the texts serves both."""

    def run(batches):
        for b in batches:
            anchors, paragraphs = [], []
            buf, off = string_buffer(b.column("text"))
            for s, e in blocks(off):
                part, at = buf[off[s] : off[e]], off[s : e + 1] - off[s]
                breaks = np.unique(np.concatenate([np.flatnonzero(part == 10) + 1, at]))
                h, counts = word_hashes(part, at, key, breaks)
                g = run_hashes(h, RUN, key) if len(h) >= RUN else h[:0]
                bound = np.searchsorted(breaks, at)
                begin, n, per = [], [], []
                for i in range(e - s):
                    x, y = int(counts[bound[i]]), int(counts[bound[i + 1]])
                    found = np.zeros(0, _ANCHOR)
                    if y - x >= RUN:
                        runs = g[x : y - RUN + 1]
                        chosen = _chosen(runs)
                        found = np.zeros(len(chosen), _ANCHOR)
                        found["h"], found["at"] = runs[chosen].view(np.int64), chosen
                    anchors.append(found.tobytes())
                    stretches = _lines(counts[bound[i] : bound[i + 1] + 1], min_words)
                    begin += [b for b, _ in stretches]
                    n += [m for _, m in stretches]
                    per.append((x, len(stretches)))
                begin, n = np.array(begin, np.int64), np.array(n, np.int64)
                rows = np.zeros(len(n), _PARAGRAPH)
                if len(n):
                    rows["at"] = begin - np.repeat([x for x, _ in per], [c for _, c in per])
                    rows["n"], rows["digest"] = n, _digests(h, begin, n, key).view("V16")[:, 0]
                    rows["sketch"] = sketches(run_hashes(h, k, key), begin, n - k + 1, BANDS * ROWS).view(f"V{2 * BANDS * ROWS}")[:, 0]
                done = 0
                for _, c in per:
                    paragraphs.append(rows[done : done + c].tobytes())
                    done += c
            columns = [b.column("doc_id"), pa.array(anchors, pa.binary()), pa.array(paragraphs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "anchors", "paragraphs"])

    return texts.mapInArrow(run, "doc_id long, anchors binary, paragraphs binary")


def _unpacked(units: DataFrame, column: str, kind: np.dtype, schema: str) -> DataFrame:
    """doc_id and the fields of the packed records of a column."""

    def run(batches):
        for b in batches:
            packed = b.column(column).to_pylist()
            rows = np.frombuffer(b"".join(packed), kind)
            ids = np.repeat(b.column("doc_id").to_numpy(), [len(p) // kind.itemsize for p in packed])
            fields = [pa.array(np.ascontiguousarray(rows[f])) if kind[f].kind == "i" else pa.array([x.tobytes() for x in rows[f]], pa.binary()) for f in kind.names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *fields], ["doc_id", *kind.names])

    return units.select("doc_id", column).mapInArrow(run, schema)


EDGES = "h long, doc_id long, at int, left boolean, right boolean, n_copies long, head_id long, head_at int"


def _edges(anchors: DataFrame) -> DataFrame:
    """EDGES of the copies at which a stretch of copies begins (left) or ends (right)."""
    often = anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = anchors.join(often, "h", "left_semi")
    heads = places.groupBy("h").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "at")).alias("head"), F.max(F.struct("doc_id", "at")).alias("tail"))
    copies = places.join(heads.filter("head <> tail"), "h").filter("doc_id <> head.doc_id OR at <> head.at")
    copies = copies.select("h", "doc_id", "at", "n_copies", F.col("head.doc_id").alias("head_id"), F.col("head.at").alias("head_at"))
    w = Window.partitionBy("doc_id").orderBy("at")  # one document's

    def parted(other):
        """From the copy before or after: neither overlaps it nor, among WINDOW words, goes on at the same first place."""
        gap = F.abs(other("at") - F.col("at"))
        same = (other("head_id") == F.col("head_id")) & (other("head_at") - F.col("head_at") == other("at") - F.col("at"))
        return F.coalesce(~((gap <= RUN) | ((gap <= WINDOW) & same)), F.lit(True))

    copies = copies.withColumn("left", parted(lambda c: F.lag(c).over(w))).withColumn("right", parted(lambda c: F.lead(c).over(w)))
    copies = copies.select(*[c.split()[0] for c in EDGES.split(", ")])
    return cut(copies.filter("left OR right"), release=True)


def _hashed(texts: DataFrame, key: HashKey) -> DataFrame:
    """(doc_id, words): 32 bits of each word's hash. They take less room than the texts, and to compare words in a row they do."""

    def run(batches):
        for b in batches:
            out = []
            buf, off = string_buffer(b.column("text"))
            for s, e in blocks(off):
                h, counts = word_hashes(buf[off[s] : off[e]], off[s : e + 1] - off[s], key)
                h = h.astype("<u4")
                out += [h[x:y].tobytes() for x, y in zip(counts[:-1].tolist(), counts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "words"])

    return texts.mapInArrow(run, "doc_id long, words binary")


def _looked_up(texts: DataFrame, wanted: DataFrame, k: int, key: HashKey) -> DataFrame:
    """What wanted asks of the texts: EDGES with low and around, the hashes of the words near an anchor, and id with the
    members of a paragraph's set. One shuffle of the texts' words serves both.

    wanted: doc_id, at, n (words of a paragraph, null for an anchor), id and EDGES. Of rows that share a doc_id with other
    texts, what doesn't fit is told apart later, when words are compared.
    """
    names = [c.split()[0] for c in EDGES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in EDGES.split(", ")] + [pa.int32(), pa.binary(), pa.int64()]

    def run(batches):
        for b in batches:
            rows = []
            for words, wanted in zip(b.column("words").to_pylist(), b.column("wanted").to_pylist()):
                h = np.frombuffer(words, "<u4")
                for w in wanted:
                    at, n = w["at"], w["n"]
                    if n is not None:
                        if at + n <= len(h):
                            members = next(shingle_sets(h[at : at + n].astype(np.uint64), np.array([0, n]), k, key))
                            rows.append([None] * len(names) + [None, members.tobytes(), w["id"]])
                    elif at + RUN <= len(h):
                        low = max(0, at - REACH)
                        rows.append([w[c] for c in names] + [low, words[4 * low : 4 * (at + RUN + REACH)], None])
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*names, "low", "blob", "id"])

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("n", "id", *names)).alias("wanted"))
    held = _hashed(texts, key).join(asked, "doc_id").select("words", "wanted")
    return cut(held.mapInArrow(run, f"{EDGES}, low int, blob binary, id long"), release=True)


def _drawn_out(pairs: DataFrame) -> DataFrame:
    """EDGES with word and end_word of the copy, and head_word and head_end_word at its first place: as far as the words on
    both sides go on equal. Pairs whose anchors' words differ are dropped."""
    kept = [c.split()[0] for c in EDGES.split(", ")]

    def run(batches):
        for b in batches:
            rows, stay = [], []
            for r in b.select(["at", "low", "blob", "head_at", "head_low", "head_blob"]).to_pylist():
                x, y = np.frombuffer(r["blob"], "<u4"), np.frombuffer(r["head_blob"], "<u4")
                i, j = r["at"] - r["low"], r["head_at"] - r["head_low"]
                ok = bool((x[i : i + RUN] == y[j : j + RUN]).all())
                stay.append(ok)
                if not ok:
                    continue
                n = min(i, j)
                differ = np.flatnonzero(x[i - n : i] != y[j - n : j])
                left = n - 1 - int(differ[-1]) if len(differ) else n
                x, y = x[i + RUN :], y[j + RUN :]
                n = min(len(x), len(y))
                differ = np.flatnonzero(x[:n] != y[:n])
                right = RUN + (int(differ[0]) if len(differ) else n)
                rows.append([r["at"] - left, r["at"] + right, r["head_at"] - left, r["head_at"] + right])
            arrays = b.select(kept).filter(pa.array(stay, pa.bool_())).columns
            arrays = [*arrays, *(pa.array(np.array(c, np.int32)) for c in (zip(*rows) if rows else [[]] * 4))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "word", "end_word", "head_word", "head_end_word"])

    return pairs.mapInArrow(run, f"{EDGES}, word int, end_word int, head_word int, head_end_word int")


PASSAGE = ["doc_id", "first_word", "end_word", "first_doc_id", "first_place", "n_copies", "kept"]


def _stretches(around: DataFrame, min_words: int) -> DataFrame:
    """PASSAGE of stretches that other places repeat, wherever lines begin or end. A first place has one row; where a
    passage goes on from another first place, that row ends before it."""
    heads = around.filter("left IS NULL").select("h", F.col("low").alias("head_low"), F.col("blob").alias("head_blob")).distinct()
    ends = _drawn_out(around.filter("left IS NOT NULL").drop("id").join(heads, "h")).dropDuplicates(["doc_id", "at"])
    # a passage is a left edge and the next right edge
    w = Window.partitionBy("doc_id").orderBy("at")
    z = F.first(F.when(F.col("right"), F.struct(*ends.columns)), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = ends.withColumn("z", z).filter("left AND z IS NOT NULL").filter(F.col("z.end_word") - F.col("word") >= min_words)
    same = (F.col("z.head_id") == F.col("head_id")) & (F.col("z.head_word") - F.col("head_word") == F.col("z.word") - F.col("word"))
    last = F.when(same | (F.col("z.at") == F.col("at")), F.col("z.head_end_word")).otherwise(F.col("head_end_word"))
    spans = cut(spans.withColumn("head_last", last), release=True)
    # a place that an anchor of its own makes first can be a copy of an earlier one all the same
    again = spans.select(F.col("doc_id").alias("head_id"), F.col("word").alias("head_word"), F.col("z.end_word").alias("to"), F.col("head_id").alias("id"), F.col("head_word").alias("place"))
    spans = spans.join(again.dropDuplicates(["head_id", "head_word"]), ["head_id", "head_word"], "left")
    is_copy = F.coalesce(F.col("head_last") <= F.col("to"), F.lit(False))
    earlier = {"head_id": F.col("id"), "head_word": F.col("place"), "head_last": F.col("place") + F.col("head_last") - F.col("head_word")}
    spans = spans.select("doc_id", "word", "z", "n_copies", *[F.when(is_copy, e).otherwise(F.col(c)).alias(c) for c, e in earlier.items()])
    out = spans.select("doc_id", F.col("word").alias("first_word"), "z.end_word", F.col("head_id").alias("first_doc_id"), F.col("head_word").alias("first_place"), "n_copies", F.lit(False).alias("kept"))
    firsts = spans.groupBy("head_id", "head_word").agg(F.max("head_last").alias("end_word"), F.max("n_copies").alias("n_copies"))
    firsts = firsts.select(F.col("head_id").alias("doc_id"), F.col("head_word").alias("first_word"), "end_word", F.col("head_id").alias("first_doc_id"), F.col("head_word").alias("first_place"), "n_copies", F.lit(True).alias("kept"))
    return out.unionByName(firsts)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, first_word, end_word, first_doc_id, first_place, n_copies, kept) of passages with copies.

    Words are numbered from 0 in each text, [first_word, end_word). first_doc_id and first_place tell where the passage
    comes first, by doc_id and place; kept marks that place. n_copies: places, those of repeated rows too. Passages inside
    a paragraph that has a row need none of their own. What has no copies, and so most documents, has no row.
    Null and empty texts, and texts with fewer words than min_words, have no passages; rows without a doc_id take no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    key = HashKey()
    units = cut(_units(texts, key, min_words, k))
    edges = _edges(_unpacked(units, "anchors", _ANCHOR, "doc_id long, h long, at int"))
    none = lambda kind: F.lit(None).cast(kind)
    places = edges.select(
        "h", F.col("head_id").alias("doc_id"), F.col("head_at").alias("at"), none("boolean").alias("left"), none("boolean").alias("right"), none("long").alias("n_copies"),
        "head_id", "head_at",
    ).distinct().unionByName(edges)
    places = places.select("*", none("int").alias("n"), none("long").alias("id"))

    found = _unpacked(units, "paragraphs", _PARAGRAPH, "doc_id long, at int, n int, digest binary, sketch binary")
    head = F.min(F.struct("doc_id", "at", "n"))
    classes = found.groupBy("digest").agg(F.count("*").alias("copies"), head.alias("head"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), release=True)
    loaded = []

    def load(ids: DataFrame) -> DataFrame:
        sets = classes.join(ids, "id", "left_semi").select("id", "head.doc_id", "head.at", "head.n")
        loaded.append(_looked_up(texts, places.unionByName(sets, allowMissingColumns=True), k, key))
        return loaded[0].filter("id IS NOT NULL").select("id", F.col("blob").alias("members")).dropDuplicates(["id"])

    groups = linked(classes.select("id", "sketch"), load, percent, ROWS, judged=False)
    # a cluster is several classes, or one with copies
    of = classes.select("id", "digest", "copies", "head").join(groups, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    sums = of.groupBy("component_id").agg(F.sum("copies").alias("n_copies"), F.min("head").alias("first"))
    named = cut(of.filter("copies > 1 OR id <> component_id").select("component_id").distinct().join(sums, "component_id").join(of.select("component_id", "digest"), "component_id"), release=True)
    out = found.select("doc_id", "at", "n", "digest").join(named, "digest").dropDuplicates(["doc_id", "at", "digest"])
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))
    out = out.select(
        "doc_id", F.col("at").alias("first_word"), (F.col("at") + F.col("n")).alias("end_word"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_place"),
        "n_copies", kept.alias("kept"),
    )
    # a repeated row alone is no copy
    single = out.groupBy("first_doc_id", "first_place").agg(F.max(~F.col("kept")).alias("more")).filter("more").drop("more")
    out = cut(out.join(single, ["first_doc_id", "first_place"], "left_semi").select(*PASSAGE), release=True)
    over = out.select(F.col("doc_id").alias("of"), F.col("first_word").alias("from"), F.col("end_word").alias("to"), F.col("kept").alias("stays"))
    within = F.expr("doc_id = of AND first_word >= from AND end_word <= to AND (kept OR NOT stays)")
    inner = _stretches(loaded[0].filter("id IS NULL"), min_words)
    return out.unionByName(inner.join(over, within, "left_anti"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the removed passages of their texts; every row stays, if need be with an empty text.

    A passage goes from its first word to the end of its last; a line that it fills goes with its end.
    """
    gone = repeated_passages(docs, min_words, k, percent).filter("NOT kept")
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("gone"))
    names = docs.schema.names
    # the other columns stay together under one name, whatever theirs are
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    held = docs.select(rest, F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text"))
    joined = held.join(gone.withColumnRenamed("doc_id", "of"), "of", "left")

    def run(batches):
        for b in batches:
            text = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("gone").to_pylist()):
                if spans and text[i] is not None:
                    text[i] = _without(text[i].encode(), [(s["first_word"], s["end_word"]) for s in spans]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string())], ["row", "text"])

    kind = held.schema["row"].dataType.simpleString()
    out = joined.select("row", "text", "gone").mapInArrow(run, f"row {kind}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names])


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without spans of its words."""
    buf = np.frombuffer(raw, np.uint8)
    first, end = word_places(buf, np.array([0, len(buf)]))
    out, at = [], 0
    for a, z in sorted(spans):
        if z > len(first):
            continue  # another text's
        start, stop = int(first[a]), int(end[z - 1])
        after = stop
        while after < len(raw) and raw[after] in b" \t\r":
            after += 1
        line = raw.rfind(b"\n", 0, start) + 1
        if not raw[line:start].strip() and (after == len(raw) or raw[after] == 10):
            stop = min(after + 1, len(raw))
        if start > at:
            out.append(raw[at:start])
        at = max(at, stop)
    return b"".join([*out, raw[at:]])
