"""Vectors that take part in a comparison."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(table: DataFrame, *more: str) -> DataFrame:
    """(id, v, valid, *more): one row for every non-null vec_id, v as array<double>.

    valid: not null, no null or non-finite component, not all zero. Rows that repeat a vec_id count once (the
    smallest row stays); rows without one are left out.
    """
    v = F.col("embedding").cast("array<double>")
    pick = F.min(F.struct(*more, v.alias("v"))).alias("r")
    df = table.filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("id")).agg(pick)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    return df.select("id", "r.*").withColumn("valid", F.coalesce(valid, F.lit(False)))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), -1)
