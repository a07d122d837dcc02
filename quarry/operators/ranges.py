"""Rows dealt to tasks by ranges of (word, key), with bounds drawn from a few rows, so that what makes the rows runs once."""

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Input rows that are looked at for the bounds, and output rows of a range, about.
LOOKED_AT, EACH = 1000, 1_000_000
PART = "_part"


def some(rows: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """A few of n rows, and how many each stands for. For bounds only: which rows they are changes no result."""
    each = max(1, n // LOOKED_AT)
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(each)) == 0), each


def bounds(looked_at: list[tuple], stands_for: int) -> list[tuple]:
    """Upper bounds (word, key) of all ranges but the last; looked_at: (word, key, weight)."""
    looked_at = sorted(looked_at)
    parts = int(-(-sum(w for _, _, w in looked_at) * stands_for // EACH)) if looked_at else 1
    if parts < 2:
        return []
    total = np.cumsum([w for _, _, w in looked_at])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return sorted({looked_at[i][:2] for i in at.tolist()})


def part_of(words: list[str], code: np.ndarray, keys: pa.Array, ends: list[tuple]) -> np.ndarray:
    """The range of each row (words[code], key): how many bounds are below it."""
    if not ends:
        return np.zeros(len(code), np.int32)
    first = [w for w, _ in ends]
    low = np.array([bisect_left(first, w) for w in words], np.int32)
    high = np.array([bisect_right(first, w) for w in words], np.int32)
    out = low[code]
    split = np.flatnonzero((high > low)[code])  # words that fill a range by themselves
    if len(split):
        own = np.array([k if k is not None else "" for k in keys.take(pa.array(split)).to_pylist()], object) if pa.types.is_string(keys.type) else keys.take(pa.array(split)).fill_null(0).to_numpy()
        of = code[split]
        for c in np.unique(of).tolist():
            here = np.flatnonzero(of == c)
            at = np.array([k for _, k in ends[low[c] : high[c]]], own.dtype)
            out[split[here]] += np.searchsorted(at, own[here]).astype(np.int32)
    return out


def deal(rows: DataFrame, ends: list[tuple], order: list[str]) -> DataFrame:
    """Rows with their range in PART, each range in a task of its own and in order; without PART."""
    return rows.repartitionById(len(ends) + 1, PART).drop(PART).sortWithinPartitions(*order)
