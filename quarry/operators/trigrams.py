"""Substring and pattern search over posting lists of trigrams: candidates from the lists, texts read for those only."""

import re
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranges

#: Characters of a gram, and bytes of text in one block of the text store.
GRAM, BLOCK_BYTES = 3, 64 << 20
LEAST_BLOCKS, MOST_BLOCKS = 16, 1 << 16
#: Candidates whose keys are pushed into the scan one by one.
FEW = 10
#: Characters whose grams a task holds at a time, and keys that weigh as much as a row when ranges are cut.
BATCH_CHARS, KEYS_A_ROW = 4_000_000, 8


def folded(text: Column) -> Column:
    """A text in lower case. The two small sigmas count as one, since which of them a capital becomes depends on what stands beside it."""
    return F.translate(F.lower(text), "ς", "σ")


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case, in one pass: a look ahead at each place."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


class TrigramIndex:
    """Postings (gram, block, keys), sorted by gram, and the texts themselves, a folder for each block of keys and sorted in it.

    A gram has a row of keys for each stretch of a block's texts."""

    def __init__(self, postings: DataFrame, texts: DataFrame, columns: list[str], blocks: int):
        self.postings, self.texts, self.columns, self.blocks = postings, texts, columns, blocks

    def candidates(self, every: list[list[str]]) -> DataFrame:
        """(key, block) of rows that have all trigrams of all literals of at least one of the alternatives, in whatever columns."""
        wanted = [sorted({g for literal in alternative for g in _literal_grams(literal)}) for alternative in every]
        if not every or not all(wanted):
            raise ValueError(f"a needle or pattern needs {GRAM} characters in a row that are always there")
        hits = self.postings.filter(F.col("gram").isin(sorted({g for gs in wanted for g in gs}))).select("gram", "block", F.explode("keys").alias("key"))
        counts = [F.count_if(F.col("gram").isin(gs)) == len(gs) for gs in wanted]
        test = counts[0]
        for c in counts[1:]:
            test = test | c
        by = hits.groupBy("key", "block").agg(test.alias("has"))
        return by.filter("has").select("key", "block")

    def rows(self, candidates: DataFrame) -> DataFrame:
        """The texts of candidates. Only their blocks' folders are read; a few keys reach the scan themselves."""
        candidates = candidates.cache()
        try:
            few = candidates.limit(FEW + 1).collect()
            if len(few) <= FEW:
                return self.texts.filter(F.col("block").isin(sorted({r.block for r in few})) & F.col("key").isin([r.key for r in few]))
            held = [r.block for r in candidates.select("block").distinct().collect()]  # at most MOST_BLOCKS numbers
            narrowed = self.texts if len(held) == self.blocks else self.texts.filter(F.col("block").isin(held))
            return narrowed.join(candidates.select("key"), "key", "left_semi")
        finally:
            candidates.unpersist()


def write_trigrams(rows: DataFrame, key: str, columns: dict[str, Column], folder: str, carried: list[str] = ()) -> TrigramIndex:
    """Writes the texts (key, columns, carried) by blocks and their postings; a row's trigrams are those of all its columns."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in columns.values()), F.lit(0)).cast("long")).alias("n")).first().n or 0
    blocks = min(max(LEAST_BLOCKS, size // BLOCK_BYTES), MOST_BLOCKS)
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
    stored = rows.select(F.col(key).alias("key"), *[c.alias(name) for name, c in columns.items()], *carried, block.alias("block"))
    stored.repartition("block").sortWithinPartitions("block", "key").write.partitionBy("block").parquet(f"{folder}/texts")
    texts = spark.read.schema(stored.schema).parquet(f"{folder}/texts")
    n, kind = texts.count(), texts.schema["key"].dataType.simpleString()
    low = lambda part: part.select("block", "key", *[folded(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(columns)])
    few, each = ranges.some(texts, "key", n)
    ends = ranges.bounds([tuple(r) for r in low(few).mapInArrow(_gram_lists(len(columns), kind, None), "gram string, block int, n long").collect()], each)
    # by ranges of (gram, block): a gram that a third of all texts have fills many rows of keys
    made = low(texts).mapInArrow(_gram_lists(len(columns), kind, ends), f"gram string, block int, keys array<{kind}>, {ranges.PART} int")
    ranges.deal(made, ends, ["gram", "block"]).write.parquet(f"{folder}/postings")
    return TrigramIndex(spark.read.parquet(f"{folder}/postings"), texts, list(columns), blocks)


def _gram_lists(columns: int, kind: str, ends: list[tuple] | None):
    """From texts (block, key, folded text of each column) to the keys of each gram in a stretch of texts of one block; without
    ends, to the number of these."""

    def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The code points of all texts, and how many each has."""
        raw = [t.encode("utf-32-le") for t in texts.to_pylist()]
        return np.frombuffer(b"".join(raw), np.uint32), np.array([len(r) // 4 for r in raw], np.int64)

    def slices(b):
        blocks = b.column(0).to_numpy()
        sizes = sum(np.diff(np.frombuffer(b.column(k + 2).buffers()[1], np.int32)[b.column(k + 2).offset :][: b.num_rows + 1].astype(np.int64)) for k in range(columns))
        at, filled = 0, np.cumsum(sizes)
        turns = np.append(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, b.num_rows)
        while at < b.num_rows:  # at least one text, however long
            end = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BATCH_CHARS, side="right")))
            end = min(end, int(turns[np.searchsorted(turns, at, side="right")]))
            yield b.slice(at, end - at)
            at = end

    def made(b):
        found, rows = [], []
        for k in range(columns):
            c, n = points(b.column(k + 2))
            if len(c) < GRAM:
                continue
            row = np.repeat(np.arange(b.num_rows), n)
            inside = np.flatnonzero(row[GRAM - 1 :] == row[: 1 - GRAM])
            c = c.astype(np.int64)
            found.append((c[inside] << 42) | (c[inside + 1] << 21) | c[inside + 2])
            rows.append(row[inside])
        code = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)).dictionary_encode()
        distinct = code.dictionary.to_numpy()
        order = np.argsort(distinct)  # by code points, as strings are
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        both = np.sort(rank[code.indices.to_numpy()] * b.num_rows + (np.concatenate(rows) if rows else np.zeros(0, np.int64)))
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        first = np.searchsorted(both, np.arange(len(order)) * b.num_rows)
        words = [chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in distinct[order].tolist()]
        terms, block = pa.array(words, pa.string()), pa.array(np.full(len(order), b.column(0)[0].as_py(), np.int32))
        if ends is None:
            return pa.RecordBatch.from_arrays([terms, block, pa.array(1 + np.diff(np.append(first, len(both))) // KEYS_A_ROW)], ["gram", "block", "n"])
        keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)).astype(np.int32)), b.column(1).take(pa.array(both % b.num_rows)))
        part = ranges.part_of(words if ends else [], np.arange(len(words)), block, ends)
        return pa.RecordBatch.from_arrays([terms, block, keys, pa.array(part)], ["gram", "block", "keys", ranges.PART])

    def run(batches):
        for b in batches:
            for part in slices(b):
                yield made(part)

    return run


_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _literal_grams(literal: str) -> set[str]:
    """A literal's trigrams, without those whose lower case isn't plain."""
    plain = [c.isascii() or c.lower() == c for c in literal]
    low = literal.lower().replace("ς", "σ") if all(plain) else "".join(c.lower() if ok else c for c, ok in zip(literal, plain)).replace("ς", "σ")
    return {low[i : i + GRAM] for i in range(len(low) - GRAM + 1) if all(plain[i : i + GRAM])}


def literal_runs(pattern: str) -> list[list[str]]:
    """Alternatives of literal runs, all of which every text that matches the pattern holds (in some case); [] where none is sure.

    Only what is read alike by both kinds of pattern counts: a pattern that cannot be parsed here has no sure runs.
    """
    try:
        tree = sre_parser.parse(pattern)
    except re.error:
        return []
    found = [[run for run in alternative if len(run) >= GRAM] for alternative in _alternatives(tree)]
    return found if all(any(_literal_grams(run) for run in alternative) for alternative in found) else []


def _alternatives(tree) -> list[list[str]]:
    """Each way through the pattern as the runs on it; groups that may be left out break runs."""
    ways: list[list[str]] = [[""]]
    for op, args in tree:
        if op is sre.LITERAL:
            parts, glue = [[chr(args)]], True
        elif op in _REPEATS and len(args[2]) == 1 and args[2][0][0] is sre.LITERAL and 0 < args[0] <= 32:
            again = chr(args[2][0][1]) * args[0]  # what may follow comes after that many at least
            ways = [[*way[:-1], way[-1] + again, *([] if args[0] == args[1] else [again])] for way in ways]
            continue
        elif op is sre.SUBPATTERN:
            parts, glue = _alternatives(args[3]), False
        elif op is sre.BRANCH:
            parts, glue = [way for branch in args[1] for way in _alternatives(branch)], False
        elif op in _REPEATS and args[0] > 0:
            parts, glue = _alternatives(args[2]), False
        elif op is sre.AT:
            continue
        else:
            parts, glue = [[]], False
        if glue:
            ways = [[*way[:-1], way[-1] + parts[0][0]] for way in ways]
        elif len(ways) * len(parts) <= 64:
            ways = [[*way, *part, ""] for way in ways for part in parts]
        else:  # too many ways: what comes is unsure, what was stays
            ways = [[*way, ""] for way in ways]
    return [[run for run in way if run] for way in ways]


def grep(index: TrigramIndex, needle: str | None = None, pattern: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """(key, columns, carried) of rows one of whose columns holds the needle, and matches the pattern if there is one.

    The needle, or without one the pattern's sure runs, must have GRAM characters; a shorter one is refused by name, as it would
    read all texts. Case counts where case_sensitive.
    """
    if needle is not None:
        needle = needle.strip()
        if len(needle) < GRAM:
            raise ValueError(f"a needle needs at least {GRAM} characters, this one has {len(needle)}")
        asked = [[needle]] if _literal_grams(needle) else None
    else:
        asked = literal_runs(pattern or "") or [[]]
    rows = index.texts if asked is None else index.rows(index.candidates(asked))
    tests = []
    for c in index.columns:
        test = F.lit(True)
        if needle is not None:
            test = F.contains(F.col(c), F.lit(needle)) if case_sensitive else F.contains(F.lower(c), F.lower(F.lit(needle)))
        if pattern:
            test = test & F.col(c).rlike(pattern if case_sensitive else "(?i)" + pattern)
        tests.append(F.coalesce(test, F.lit(False)))
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return rows.filter(hit)


def containing(index: TrigramIndex, probes: DataFrame, probe_key: str, probe: str, column: str, keys: int = 3) -> DataFrame:
    """(probe_key, key) of all texts that hold a probe's whole text, in its own case.

    A probe meets texts by its `keys` rarest trigrams and is then compared. Probes of one or two characters meet texts by
    the equal pieces of these, which needs no comparison. Empty probes are in every text and left to the caller; null
    probes and texts have no pairs.
    """
    asked = probes.filter(F.col(probe).isNotNull()).select(F.col(probe_key).alias("_p"), F.col(probe).alias("_t"))
    texts = index.texts.filter(F.col(column).isNotNull())
    size = F.char_length("_t")
    long, short = asked.filter(size >= GRAM), asked.filter((size > 0) & (size < GRAM))
    wanted = long.select("_p", F.explode(grams(F.col("_t"))).alias("gram"))
    lists = index.postings.join(wanted.select("gram").distinct(), "gram", "left_semi")
    counted = wanted.join(lists.groupBy("gram").agg(F.sum(F.size("keys")).alias("df")), "gram", "left")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, keys)
    few = counted.groupBy("_p").agg(rarest.alias("few"))
    chosen = few.select("_p", F.size("few").alias("n"), F.explode("few.gram").alias("gram"))
    met = chosen.join(lists, "gram").select("_p", "n", F.explode("keys").alias("key")).groupBy("_p", "key").agg(F.count("*").alias("hits"), F.first("n").alias("n")).filter("hits = n")
    compared = met.select("_p", "key").join(long, "_p").join(texts.select("key", F.col(column).alias("_x")), "key")
    found = compared.filter(F.contains("_x", F.col("_t"))).select("_p", "key")
    if short.isEmpty():  # else all texts are cut into their pieces
        return found.select(F.col("_p").alias(probe_key), "key")
    pieces = F.flatten(F.array(*[F.regexp_extract_all(F.col(column), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2)]))
    brief = texts.select("key", F.explode(F.array_distinct(pieces)).alias("_t")).join(short, "_t").select("_p", "key")
    return found.union(brief).select(F.col("_p").alias(probe_key), "key")
