"""Dataset statistics in one pass, with sketches that can be merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOTAL = "total"


def dataset_statistics(df: DataFrame, dimensions: list[str], measure: Column, identity: Column) -> DataFrame:
    """A row for each value of each dimension, and one for the whole table.

    Columns: dimension, value, n_rows, total, least, greatest of ``measure``, and two sketches as binary columns:
    ``quantiles`` (KLL, of the measure) and ``identities`` (HyperLogLog, of ``identity``). Grouping sets work them all
    out in one pass, combined map-side. Null values of a dimension are a value of their own; rows with a null measure count as rows
    only. An empty table gives no rows.
    """
    rows = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], measure.cast("bigint").alias("_measure"), identity.alias("_identity"))
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n_rows"), F.sum("_measure").alias("total"), F.min("_measure").alias("least"),
        F.max("_measure").alias("greatest"), F.kll_sketch_agg_bigint("_measure").alias("quantiles"), F.hll_sketch_agg("_identity").alias("identities"))
    every = (1 << len(dimensions)) - 1
    dimension, value = F.lit(TOTAL), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("_set") == every - (1 << (len(dimensions) - 1 - i))
        dimension, value = F.when(here, d).otherwise(dimension), F.when(here, F.col(d)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n_rows", F.coalesce("total", F.lit(0)).alias("total"), "least", "greatest",
                          "quantiles", "identities")


def merge_statistics(*tables: DataFrame) -> DataFrame:
    """Statistics of several tables as those of all their rows together, sketches included."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("dimension", "value").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.hll_union_agg("identities").alias("identities"))


def read_statistics(statistics: DataFrame, quantiles: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Statistics with the sketches read: mean, n_distinct (within about 2 %) and a q column for each quantile (its
    rank within about 2 % of the rows)."""
    reads = [F.when(F.col("least").isNotNull(), F.kll_sketch_get_quantile_bigint("quantiles", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return statistics.select("dimension", "value", "n_rows", "total", "least", "greatest",
                             F.try_divide(F.col("total").cast("double"), F.col("n_rows")).alias("mean"),
                             F.hll_sketch_estimate("identities").alias("n_distinct"), *reads)
