"""Ranked text search: a token table, BM25, staged widening, literal search, fusion."""

import math
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import ranges

K1, B, RRF_K = 1.2, 0.75, 60
COLUMN_BITS = 40
#: Terms that a task holds at a time while it counts, and of how many tokens one is looked at for the bounds of ranges.
BATCH_TERMS, SPARED = 1_000_000, 8


class TextIndex:
    """An inverted index in Parquet: tokens (term, key, len, tf of each column, places), sorted by term and key, and the corpus's size.

    places: where in the row the term stands, the number of its column in the bits from COLUMN_BITS on.
    """

    def __init__(self, tokens: DataFrame, columns: list[str], n: int, average: float):
        self.tokens, self.columns, self.n, self.average = tokens, columns, n, average

    def hits(self, words: list[str], prefixes: bool = False) -> DataFrame:
        """The tokens that equal a word or, for words of PREFIX_FROM characters and more, begin with it: filters that reach the scan."""
        test = F.col("term").isin(words)
        for w in words if prefixes else ():
            if len(w) >= tx.PREFIX_FROM:
                test = test | F.col("term").startswith(w)
        return self.tokens.filter(test)


def write_index(rows: DataFrame, key: str, columns: dict[str, Column], folder: str) -> TextIndex:
    """Tokenises the columns once and writes the index; queries read the terms they ask for.

    All tokens of a row are in that row, so they are counted in the task that reads it, and one shuffle brings them into order.
    """
    (n, different), kind = rows.agg(F.count("*"), F.countDistinct(key)).first(), rows.schema[key].dataType.simpleString()
    cut = lambda part: part.select(F.col(key).alias("key"), *[tx.terms(F.coalesce(column, F.lit(""))).alias(f"t{k}") for k, column in enumerate(columns.values())])
    few, each = ranges.some(rows, key, n)
    drawn = cut(few).mapInArrow(_postings(list(columns), None), f"term string, key {kind}").collect()  # one of SPARED tokens of a few rows
    ends = ranges.bounds([(*r, SPARED) for r in drawn], each)
    counts = ", ".join(f"tf_{c} long" for c in columns)
    counted = cut(rows).mapInArrow(_postings(list(columns), ends), f"key {kind}, term string, len int, {counts}, places array<long>, {ranges.PART} int")
    # by ranges of (term, key): a term that a third of all rows have fills many files
    ranges.deal(counted, ends, ["term", "key"]).write.parquet(f"{folder}/tokens")
    tokens = rows.sparkSession.read.parquet(f"{folder}/tokens")
    total = tokens.agg(F.sum(sum(F.col(f"tf_{c}") for c in columns))).first()[0]
    if different < n:  # rows that share a key, or have none, count as one
        sums = [F.sum(f"tf_{c}").alias(f"tf_{c}") for c in columns]
        tokens = tokens.groupBy("key", "term").agg(F.first("len").alias("len"), *sums, F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    return TextIndex(tokens, list(columns), n, (total or 0) / max(n, 1))


def _postings(columns: list[str], ends: list[tuple] | None):
    """From rows (key, terms of each column) to the index's rows, in order of term within a batch; without ends, to (term, key) of
    some of them."""

    def slices(b):
        sizes = sum(pc.list_value_length(b.column(k + 1)).to_numpy() for k in range(len(columns)))
        at, filled = 0, np.cumsum(sizes)
        while at < b.num_rows:  # at least one row, however long
            end = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BATCH_TERMS, side="right")))
            yield b.slice(at, end - at)
            at = end

    def made(b):
        sizes = [pc.list_value_length(b.column(k + 1)).to_numpy() for k in range(len(columns))]
        total, rows = sum(sizes), np.arange(b.num_rows)
        found = pa.concat_arrays([b.column(k + 1).flatten() for k in range(len(columns))]).dictionary_encode()
        row = np.concatenate([np.repeat(rows, n) for n in sizes])
        place = np.concatenate([(k << COLUMN_BITS) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for k, n in enumerate(sizes)])
        words = found.dictionary.take(order := pc.sort_indices(found.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        both = rank[found.indices.to_numpy()] * b.num_rows + row
        by = np.argsort(both, kind="stable")  # places stay in order
        both, place = both[by], place[by]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        code, of = both[first] // b.num_rows, both[first] % b.num_rows
        keys, terms = b.column(0).take(pa.array(of)), words.take(pa.array(code))
        if ends is None:
            some = np.flatnonzero((code * 7919 + of) % SPARED == 0)
            return pa.RecordBatch.from_arrays([terms.take(pa.array(some)), keys.take(pa.array(some))], ["term", "key"])
        tf = [np.add.reduceat((place >> COLUMN_BITS == k).astype(np.int64), first) if len(first) else first for k in range(len(columns))]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)).astype(np.int32)), pa.array(place))
        part = ranges.part_of(words.to_pylist() if ends else [], code, keys, ends)
        return pa.RecordBatch.from_arrays([keys, terms, pa.array(total[of].astype(np.int32)), *map(pa.array, tf), places, pa.array(part)], ["key", "term", "len", *[f"tf_{c}" for c in columns], "places", ranges.PART])

    def run(batches):
        for b in batches:
            for part in slices(b):
                yield made(part)

    return run


def bm25(index: TextIndex, words: list[str], weights: list[float] | None = None) -> DataFrame:
    """(key, score, n_terms): BM25 of rows with any of the words; a column's weight multiplies its term frequencies."""
    hits = index.hits(words)
    tf = sum(w * F.col(f"tf_{c}") for w, c in zip(weights or [1.0] * len(index.columns), index.columns))
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each word asked
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / index.average))
    return hits.join(df, "term").groupBy("key").agg(F.sum(one).alias("score"), F.count("*").alias("n_terms"))


def cascade(index: TextIndex, rows: DataFrame, key: str, body: str, words: list[str]) -> DataFrame:
    """(key, stage) of the first stage with any hit: 1 all terms, 2 any term or prefix, 3 any substring. Texts are read for the last only."""
    hits = index.hits(words, prefixes=True)
    exact = F.count_if(F.col("term").isin(words))
    staged = hits.groupBy("key").agg(F.when(exact == len(set(words)), 1).otherwise(2).alias("stage"))
    for stage in (1, 2):
        found = staged.filter(F.col("stage") == stage)
        if not found.isEmpty():
            return found
    inside = F.lit(False)
    for w in words:
        inside = inside | F.lower(body).contains(w)
    return rows.filter(inside).select(F.col(key).alias("key"), F.lit(3).alias("stage"))


def planned(index: TextIndex, terms: list[str], phrases: list[list[str]], among: DataFrame | None = None) -> DataFrame:
    """(key, stage) of the first stage with any hit: 1 all phrases and all terms, 2 any phrase, any term or its prefix; among: only
    rows with these keys.

    A phrase's words stand next to each other in one column: the places of each, less its offset in the phrase, have one in
    common. A row's places are gathered for the words asked alone.
    """
    words = sorted({*terms, *(w for p in phrases for w in p)})
    asked = F.col("term").isin(words)
    hits = index.hits(words, prefixes=False)
    begun = [w for w in terms if len(w) >= tx.PREFIX_FROM]
    if begun:
        hits = index.hits(sorted({*words, *begun}), prefixes=True)
    if among is not None:
        hits = hits.join(among, "key", "left_semi")
    found = F.map_from_entries(F.collect_list(F.when(asked, F.struct("term", "places"))))
    prefix = F.bool_or(_any([F.col("term").startswith(w) for w in begun])) if begun else F.lit(False)
    by = hits.groupBy("key").agg(found.alias("at"), prefix.alias("begun"))
    has = {w: F.col("at")[w].isNotNull() for w in words}
    adjacent = []
    for p in phrases:
        starts = None
        for k, w in enumerate(p):
            here = F.transform(F.col("at")[w], _less(k))
            starts = here if starts is None else F.array_intersect(starts, here)
        adjacent.append(F.coalesce(F.size(starts) > 0, F.lit(False)) & _all([has[w] for w in p]))
    every, some = _all([*adjacent, *(has[w] for w in terms)]), _any([*adjacent, *(has[w] for w in terms), F.col("begun")])
    staged = by.select("key", F.when(every, 1).when(some, 2).alias("stage")).filter("stage IS NOT NULL")
    first = staged.agg(F.min("stage").alias("least"))  # one row
    return staged.join(F.broadcast(first), staged.stage == first.least).select("key", "stage")


def _less(k: int):
    return lambda x: x - k


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def token_table(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf, len): the index's rows as a frame."""
    t = rows.select(key, tx.terms(F.col(body)).alias("_t"))
    counted = t.select(key, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return counted.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def rank(rows: DataFrame, arm: str, key: str, order: list, limit: int) -> DataFrame:
    """(arm, key, rank) of the first `limit` rows."""
    top = rows.orderBy(*order).limit(limit)
    return top.select(F.lit(arm).alias("arm"), F.col(key).alias("key"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(ranked: DataFrame) -> DataFrame:
    """(key, score, arms): reciprocal rank fusion of (arm, key, rank)."""
    return ranked.groupBy("key").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))


def identifier_like(word: str) -> bool:
    return any(c.isdigit() or c in "_-./@" for c in word)


def relevance(index: TextIndex, words: list[str], keys: DataFrame | None = None) -> DataFrame:
    """(key, score, corroborated): rarity-weighted coverage times the rarest matched term's share of the largest rarity, for
    rows with any of the words (among keys, if given). Corroborated: two words, or one that names something."""
    hits = index.hits(words).select("term", "key")
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each word asked
    n = max(index.n, 1)
    idf = {w: math.log(1 + n / (1 + df.get(w, 0))) for w in words}
    weight = F.element_at(F.create_map(*[F.lit(x) for w, v in idf.items() for x in (w, v)]), F.col("term"))
    named = F.col("term").isin([w for w in words if identifier_like(w)] or [""])
    if keys is not None:
        hits = hits.join(keys, "key", "left_semi")
    by = hits.groupBy("key").agg(F.sum(weight).alias("got"), F.max(weight).alias("rarest"), F.count("*").alias("n"), F.bool_or(named).alias("named"))
    score = F.col("got") / sum(idf[w] for w in words) * F.least(F.col("rarest") / math.log(1 + n), F.lit(1.0))
    return by.select("key", score.alias("score"), ((F.col("n") >= 2) | F.col("named")).alias("corroborated"))


def resolve(nodes: DataFrame, words: list[str], order: list) -> DataFrame:
    """The one node that words name, or none: nodes (with t, their tokens) need a word whole; the widest cover by whole words and
    beginnings wins, by `order` among equals; a cover of one word that several nodes have names none."""
    whole = [F.array_contains("t", w) for w in words]
    begun = [~a & F.exists("t", _begins(w)) if len(w) >= tx.PREFIX_FROM else F.lit(False) for a, w in zip(whole, words)]
    total = lambda tests: sum((c.cast("int") for c in tests), F.lit(0))
    strong = nodes.withColumn("exact", total(whole)).withColumn("prefix", total(begun)).filter("exact >= 1")
    cover = F.col("exact") + F.col("prefix")
    widest = strong.agg(F.max(cover).alias("widest"), F.count("*").alias("n"))  # one row
    return strong.crossJoin(F.broadcast(widest)).filter((cover == F.col("widest")) & ~((F.col("widest") == 1) & (F.col("n") > 1))).orderBy(*order).limit(1)


def _begins(w: str):
    return lambda x: x.startswith(w)
