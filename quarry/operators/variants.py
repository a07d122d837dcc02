"""Nested values of any shape as rows, and counts of different things by sketches that add up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import cut

#: Levels of nesting that are followed.
DEEPEST = 64


def json_tree(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, kind, value) of everything inside JSON texts: a row for each object, array and value, `$` being the whole.

    kind: object, array, string, number, boolean or null; value: the text of what isn't nested. Texts that aren't JSON
    have no rows; what is nested deeper than DEEPEST levels is given as its own text. One level is opened at a time, all
    rows at once.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).filter("v IS NOT NULL")
    levels = []
    for depth in range(DEEPEST):
        level = cut(level)
        levels.append(level)
        nested = level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if depth == DEEPEST - 1 or nested.isEmpty():
            break
        opened = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("k"), F.col("pos").alias("pos"), F.col("value").alias("w")))
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("k")))
        level = opened.select("key", F.concat("path", step).alias("path"), F.col("w").alias("v"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    shape = F.schema_of_variant("v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
    deep = kind.isin("object", "array")
    value = F.when(kind == "null", None).when(deep, None).otherwise(F.variant_get("v", "$", "string"))
    return out.select(F.col("key").alias(key), "path", kind.alias("kind"), value.alias("value"))


def sketches(rows: DataFrame, by: list[str], columns: list[str], bits: int = 14) -> DataFrame:
    """A row for each `by` with a sketch of each column's different values; sketches of parts add up to that of the whole."""
    return rows.groupBy(*by).agg(*[F.hll_sketch_agg(c, bits).alias(c) for c in columns])


def estimated(parts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Estimates of how many different values there are, from sketches rolled up to `by`."""
    return parts.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def error_bound(bits: int = 14) -> float:
    """Three standard errors of an estimate, as a share of the count."""
    return 3 * 1.04 / 2 ** (bits / 2)
