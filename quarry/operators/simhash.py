"""64-bit fingerprints of word 3-shingles, pairs that differ in few bits, and the greedy choice among ranked copies."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The FNV-1a parameters and the word count of a shingle.
OFFSET, PRIME, WORDS = 14695981039346656037, 1099511628211, 3
NEAR = 3
#: Longer shingles are hashed one by one.
LONG = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Signed 64-bit fingerprints; 0 without words, and of the whole text's words where they are fewer than WORDS."""
    out = np.zeros(len(texts), np.uint64)
    words = [(t or "").encode().translate(_LOWER).split() for t in texts]
    some = [i for i, w in enumerate(words) if w]
    if not some:
        return out.view(np.int64)
    # words with one space before each: a shingle is a stretch of this text without its first byte
    buf = np.frombuffer(b"".join(b" " + b" ".join(words[i]) for i in some), np.uint8)
    sizes = np.array([len(x) + 1 for i in some for x in words[i]])
    at = np.cumsum(sizes) - sizes
    n = np.array([len(words[i]) for i in some])
    k = np.minimum(n, WORDS)
    per = n - k + 1
    begin = np.repeat(np.cumsum(n) - n, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    last = begin + np.repeat(k, per) - 1
    start, end = at[begin] + 1, at[last] + sizes[last]
    h, live, step = np.full(len(start), OFFSET, np.uint64), np.flatnonzero(end > start), 0
    while len(live) and step < LONG:
        h[live] = (h[live] ^ buf[start[live] + step]) * np.uint64(PRIME)
        step += 1
        live = live[start[live] + step < end[live]]
    for i in live.tolist():
        x = int(h[i])
        for b in buf[start[i] + step : end[i]].tolist():
            x = (x ^ b) * PRIME & (1 << 64) - 1
        h[i] = x
    first = np.cumsum(per) - per
    votes = np.zeros((len(some), 64), np.int64)
    for bit in range(64):
        votes[:, bit] = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
    set_ = (2 * votes > per[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    out[some] = set_.sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def with_fingerprint(rows: DataFrame, body: str) -> DataFrame:
    """rows with simhash, made for whole batches of texts."""

    def run(texts: pd.Series) -> pd.Series:
        step = 2048
        return pd.Series(np.concatenate([fingerprints(texts.iloc[s : s + step].tolist()) for s in range(0, len(texts), step)] or [np.zeros(0, np.int64)]))

    return rows.withColumn("simhash", F.pandas_udf(run, "long")(body))


def distance(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def bands(mark: str) -> Column:
    """The blocks of a fingerprint, three of six at a time: two that differ in at most NEAR bits have one of them in common."""
    edges = [round(64 * i / 6) for i in range(7)]
    block = [F.shiftrightunsigned(mark, lo).bitwiseAND((1 << hi - lo) - 1) for lo, hi in zip(edges[:-1], edges[1:])]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(*[block[j] for j in chosen]).alias("v")) for i, chosen in enumerate(combinations(range(6), 3))])


def near_within(rows: DataFrame, others: DataFrame, within: str, key: str) -> DataFrame:
    """Keys of rows (key, within, simhash) whose fingerprint is at most NEAR bits from one of others (within, simhash) of the same
    `within`. They meet by bands, each fingerprint of a group once; zero fingerprints are near nothing."""
    theirs = others.filter("simhash <> 0").select(within, F.col("simhash").alias("theirs")).distinct().select(within, "theirs", F.explode(bands("theirs")).alias("band"))
    mine = rows.filter("simhash <> 0").select(within, "simhash").distinct().select(within, "simhash", F.explode(bands("simhash")).alias("band"))
    near = mine.join(theirs, [within, "band"]).filter(distance("simhash", "theirs") <= NEAR).select(within, "simhash").distinct()
    return rows.join(near, [within, "simhash"], "left_semi").select(key)


def near_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(a, b, distance): pairs of classes of equal fingerprints at most NEAR bits apart, a and b each class's least key; and
    every further member b of a class with its least key a, at distance 0.

    With at most 3 differing bits, three of six blocks are equal: classes meet by three blocks of 10 or 11 bits, 31 to 33 together.
    """
    marked = rows.filter("simhash <> 0").select("simhash", F.col(key).alias("b"))
    classes = marked.groupBy("simhash").agg(F.min("b").alias("a"))
    banded = classes.select("a", "simhash", F.explode(bands("simhash")).alias("band"))
    x, y = banded.select("a", F.col("simhash").alias("sa"), "band"), banded.select(F.col("a").alias("b"), F.col("simhash").alias("sb"), "band")
    near = x.join(y, "band").filter("a < b").filter(distance("sa", "sb") <= NEAR).select("a", "b", distance("sa", "sb").alias("distance")).distinct()
    copies = marked.join(classes, "simhash").filter("a <> b").select("a", "b", F.lit(0).alias("distance"))
    return near.union(copies)


def greedy(rows: DataFrame, within: list[str], key: str, order: list, exact: str | None = None) -> DataFrame:
    """rows that stay when each group's are taken in order and one is dropped that equals (exact) or nearly equals (simhash) an
    earlier one kept; absorbed: the keys dropped for it. For the short candidate lists of one question."""
    names = rows.schema.names
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    kind = ranked.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        marks, keys = part.simhash.to_numpy().astype(np.uint64), part[key].tolist()
        hashes = part[exact].tolist() if exact else [None] * len(part)
        kept, absorbed = [], {}
        for i in range(len(part)):
            of = next((j for j in kept if hashes[i] and hashes[i] == hashes[j]), None)
            if of is None and marks[i] != 0:
                of = next((j for j in kept if marks[j] != 0 and int(marks[i] ^ marks[j]).bit_count() <= NEAR), None)
            if of is None:
                kept.append(i)
                absorbed[i] = []
            else:
                absorbed[of].append(keys[i])
        return pd.DataFrame({key: [keys[i] for i in kept], "absorbed": pd.Series([absorbed[i] for i in kept], dtype=object)})

    slim = ranked.select(*dict.fromkeys([*within, key, "place", "simhash", *([exact] if exact else [])]))
    stay = slim.groupBy(*within).applyInPandas(run, f"{key} {kind}, absorbed array<{kind}>")
    return rows.join(stay, key).select(*names, "absorbed")
