"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def _checksum(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _directed(e: DataFrame) -> DataFrame:
    return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of edges (a, b) of longs: the smallest id reachable, itself included.

    Null ends and loops link nothing. Minima are pre-aggregated and joined back, so a node with very many
    neighbours is never gathered into one task. Each round is cut; rounds end when the edges stay the same.
    """
    e = cut(_directed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()), release=True)
    before = _checksum(e)
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = _directed(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        star = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(_directed(star.union(low.select("a", F.col("m").alias("b")))), release=True)
        after = _checksum(e)
        if after == before:
            break
        before = after
    leaves = e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return leaves.union(e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
