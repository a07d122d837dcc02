"""Vector expressions over array<double> columns."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where lengths differ or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def _with(a, value, use) -> Column:
    """use(v, value(v)) for v = a, each worked out once a row: a lambda would work them out for every element."""
    held = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), value(v).alias("x")))
    return F.transform(held, lambda s: use(s["v"], s["x"]))[0]


def unit(a) -> Column:
    return _with(a, norm, lambda v, n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-300))))


def quantize(a) -> tuple[Column, Column]:
    """(int8 codes as array<int>, scale) of a unit-length copy: scale is the largest magnitude over 127."""
    largest = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x))) / 127.0
    code = lambda x, scale: F.greatest(F.least(F.round(x / scale), F.lit(127.0)), F.lit(-127.0)).cast("int")
    both = _with(unit(a), largest, lambda v, scale: F.struct(F.transform(v, lambda x: code(x, scale)).alias("codes"), scale.alias("scale")))
    return both["codes"], both["scale"]


def int_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hashed_embedding(text, dim: int) -> Column:
    """A test embedder: words hashed into dim places with a sign, at length 1; zeros for a text without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)).cast("int"))

    @F.pandas_udf("array<double>")
    def signed(places: pd.Series) -> pd.Series:
        counts = (np.bincount(np.asarray(p, np.int64), minlength=2 * dim).astype(float) if p is not None else None for p in places)
        return pd.Series([None if c is None else c[:dim] - c[dim:] for c in counts], dtype=object)

    return unit(signed(place))
