"""Exact sampling: per-group heads, seeded draws, every k-th row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .order import int_div, running, shuffle_key

SALTS = 64
GROUP_LIMIT = 1000  # up to this rank Spark drops rows before the shuffle (windowGroupLimitThreshold)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with a 1-based rank.

    Two rounds: each (group, salt) keeps its own first n, then the survivors meet. The salt is the input partition, so a task
    cuts every group to n rows before anything is shuffled, a group that holds most of the rows is ranked by many tasks,
    and the last task of a group sees at most ``n * SALTS`` rows. ``order`` must end in a unique column.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = W.partitionBy(*group, "_salt").orderBy(*order)
    kept = (salted.withColumn("_local", F.row_number().over(first))
            .where(F.col("_local") <= n).drop("_local", "_salt"))
    last = W.partitionBy(*group).orderBy(*order)
    return kept.withColumn(rank_col, F.row_number().over(last)).where(F.col(rank_col) <= n)


def _first_rows(df: DataFrame, stratum: str, order_by: list[str], key: str, n: int) -> DataFrame:
    """Small heads are cut before the shuffle. For large ones the keys are ranked over range
    partitions, which spread a large stratum, and only the rows of the kept keys are fetched."""
    if n <= GROUP_LIMIT:
        return top_per_group(df, [stratum], [F.col(c) for c in order_by], n, "_rank").drop("_rank")
    ranked = running(df, order_by, within=[stratum], index_col="_rank")
    return df.join(ranked.where(F.col("_rank") < n).select(key), key, "left_semi")


def stratified_head(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each stratum in key order; ``n = 0`` keeps everything."""
    return df if n == 0 else _first_rows(df, stratum, [key], key, n)


def stratified_random(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``min(n, size)`` rows of each stratum, drawn without replacement from the seed."""
    if n == 0:
        return df
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(key)))
    return _first_rows(keyed, stratum, ["_key", key], key, n).drop("_key")


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement; all rows when there are fewer.

    The rows with the n smallest hash keys. A histogram over the top 16 bits of the key finds the
    cut, so only the rows of the cut's buckets are ranked and nothing is sorted as a whole.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(key)))
    keyed = keyed.withColumn("_bucket", F.shiftright("_key", 44))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_rows"))  # at most 65,536 rows
    before = F.sum("_rows").over(W.orderBy("_bucket")) - F.col("_rows")
    cut = counts.select("_bucket", before.alias("_before")).where(F.col("_before") < n)
    within = W.partitionBy("_bucket").orderBy("_key", key)
    return (keyed.join(F.broadcast(cut), "_bucket")  # bounded: 65,536 buckets
            .withColumn("_rank", F.col("_before") + F.row_number().over(within))
            .where(F.col("_rank") <= n)
            .drop("_key", "_bucket", "_before", "_rank"))


def systematic_sample(df: DataFrame, series: list[str], order_by: list[str], n: int) -> DataFrame:
    """Every k-th row of each series with ``k = ceil(rows / n)``, starting at the first row."""
    ranked = running(df, order_by, within=series, index_col="_index", count_col="_rows")
    picked = (ranked.where(F.col("_index") % int_div(F.col("_rows") + (n - 1), n) == 0)
              .select(*series, *order_by))
    return df.join(picked, [*series, *order_by], "left_semi")
