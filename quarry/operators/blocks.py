"""A set of queries against all rows, in blocks of both, as matrix products."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows of one block.
QUERIES, ROWS = 1024, 8192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def against(queries: DataFrame, rows: DataFrame, key: str, row_key: str, use: Callable, schema: str) -> DataFrame:
    """What `use` makes of each block: use(queries' table, rows' table, cosines rounded to 9 places), with vectors in column v.

    Both sides are dealt by hash into blocks of about QUERIES and ROWS, every block of one meets every block of the other, and only
    what `use` returns goes on; no pair leaves its block. Vectors must have one length; zero vectors are 0 to all.
    """
    n, m = queries.count(), rows.count()
    across, down = max(1, -(-n // QUERIES)), max(1, -(-m // ROWS))
    deal = lambda df, k, own, other, mine, theirs: df.withColumn(mine, F.pmod(F.xxhash64(F.col(k)), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return use(q.slice(0, 0), r.slice(0, 0), np.zeros((0, 0)))
        return use(q, r, np.round(_unit(_matrix(q["v"])) @ _unit(_matrix(r["v"])).T, 9))

    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of their own, also where both are of one frame
    left = deal(queries, key, across, down, "_across", "_down").groupBy("_across", "_down")
    right = deal(rows, row_key, down, across, "_down", "_across").groupBy("_across", "_down")
    return left.cogroup(right).applyInArrow(run, schema)
