"""Points in intervals, as an equi-join on the pieces of a dyadic grid."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stab(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, unit: int) -> DataFrame:
    """All pairs of points and intervals of the same `by` with start <= at < end; a null end is open, null starts and points hold nothing.

    Time is cut into cells of `unit`, and cells into a binary grid over the points' span. An interval is laid out in the fewest
    grid nodes that fill its whole cells, at most two a level; a point has one node a level. So each pair that holds meets in
    exactly one node and no other pair meets but in the cells in which an interval begins or ends, where it is compared.
    Points x intervals of one subject is never formed: a subject with very many of both is split over its nodes.
    Columns of the two frames, but for `by`, must have different names.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(unit)).cast("long")
    span = points.agg(F.min(cell(at)).alias("low"), F.max(cell(at)).alias("high")).first()
    low, high = (span.low, span.high) if span.low is not None else (0, 0)
    levels = (high - low).bit_length() + 1
    here = cell(at) - low
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(here, k).alias("node")) for k in range(levels)])
    dotted = points.filter(F.col(at).isNotNull()).withColumn("_n", F.explode(nodes))
    dotted = dotted.select(*points.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))

    # whole cells [a, b) and the cut cells at both ends, within the points' span
    top = F.lit(high - low + 1).cast("long")
    begin, stop = F.col(start), F.col(end)
    a = F.least(F.greatest(F.ceil(begin / F.lit(unit)).cast("long") - low, F.lit(0).cast("long")), top)
    b = F.when(stop.isNull(), top).otherwise(F.least(F.greatest(cell(end) - low, F.lit(0).cast("long")), top))
    laid = intervals.filter(begin.isNotNull() & (stop.isNull() | (begin < stop))).withColumn("_a", a).withColumn("_b", b)
    pieces = []
    for k in range(levels):
        x, y = F.shiftright(F.col("_a") + ((1 << k) - 1), k), F.shiftright("_b", k)
        piece = lambda node, k=k: F.struct(F.lit(k).alias("level"), node.alias("node"), F.lit(False).alias("cut"))
        pieces.append(F.when((x < y) & (x % 2 == 1), piece(x)))
        pieces.append(F.when((x < y) & (y % 2 == 1), piece(y - 1)))
    edge = lambda node: F.struct(F.lit(0).alias("level"), node.alias("node"), F.lit(True).alias("cut"))
    opens, closes = cell(start) - low, cell(end) - low
    pieces.append(F.when(opens * unit + low * unit != begin, edge(opens)))
    pieces.append(F.when(stop.isNotNull() & (closes * unit + low * unit != stop) & ((closes != opens) | (opens * unit + low * unit == begin)), edge(closes)))
    laid = laid.withColumn("_p", F.explode(F.array_compact(F.array(*pieces))))
    laid = laid.select(*intervals.columns, F.col("_p.level").alias("_level"), F.col("_p.node").alias("_node"), F.col("_p.cut").alias("_cut"))
    met = dotted.join(laid, [*by, "_level", "_node"])
    return met.filter(~F.col("_cut") | ((begin <= F.col(at)) & (stop.isNull() | (F.col(at) < stop)))).drop("_level", "_node", "_cut")
