"""Global order without a single-task window: dense ids, running totals, seeded shuffles.

Spark rows have no input order, so every function takes the columns that define it; together they
must be unique and not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def shuffle_key(seed, *cols: Column) -> Column:
    """A uniform 60-bit number per row from the seed and the row's identity.

    md5, so that any SQL engine can replay the order.
    """
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", seed_text, *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def int_div(a: Column, b) -> Column:
    """Integer quotient, exact beyond 2**53."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def hash_bucket(df: DataFrame, key: str = "_key") -> Column:
    """The top bits of a ``shuffle_key`` column: equal shares of the rows, a few per shuffle partition."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max((wanted - 1).bit_length(), 1), 16)
    return F.shiftright(key, 60 - bits)


def running(df: DataFrame, order_by: list[str], value: str | None = None,
            within: list[str] = (), index_col: str = "index", total_col: str = "total",
            carry: list[str] = (), count_col: str | None = None, bucket: Column | None = None) -> DataFrame:
    """The key (and carried) columns with a 0-based index and, for ``value``, its running total up to
    the row; ``count_col`` adds the number of rows of the group.

    Rows are range-partitioned on the key, so a group that holds most rows spreads over many tasks.
    Each partition counts (and sums) its own rows; the small table of partition totals gives every
    partition its offset. Only the key columns, the value and ``carry`` travel.

    ``bucket`` may name the partition of a row instead: a column that grows with the order and cuts
    the rows evenly, as ``hash_bucket`` does. Then nothing is sampled or written first.
    """
    within = list(within)
    keys = [*within, *order_by]
    columns = list(dict.fromkeys(keys + ([value] if value else []) + list(carry)))
    if bucket is None:
        rows = materialise(  # partition numbers must not change if a task is run again
            df.select(*columns)
            .repartitionByRange(*[F.col(k) for k in keys])
            .sortWithinPartitions(*keys)
            .withColumn("_slot", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftright("_slot", _PART_BITS)), "order")
        totals = [F.count("*").alias("_rows"), F.min("_slot").alias("_first")]
        local = W.partitionBy("_part", *within).orderBy("_slot")
        position = F.col("_slot") - F.col("_first")
    else:
        rows = df.select(*columns, F.coalesce(bucket, F.lit(0)).alias("_part"))
        totals = [F.count("*").alias("_rows")]
        local = W.partitionBy("_part", *within).orderBy(*order_by)
        position = F.row_number().over(local).cast("bigint") - 1
    if value:
        totals.append(F.sum(value).alias("_sum"))
    # one row per partition (and group), however many rows the input has
    offsets = rows.groupBy("_part", *within).agg(*totals)
    earlier = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if value:
        offsets = offsets.withColumn("_sum_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    if count_col:
        offsets = offsets.withColumn(count_col, F.sum("_rows").over(W.partitionBy(*within)))
    if not within:
        offsets = F.broadcast(offsets)  # bounded by the number of partitions
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(offsets[g]) for g in within],
                  rows["_part"] == offsets["_part"])
    joined = rows.join(offsets, same).drop(*[offsets[c] for c in ["_part", *within]])
    out = joined.withColumn(index_col, position + F.col("_before"))
    added = [index_col]
    if value:
        so_far = F.sum(value).over(local.rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumn(total_col, F.col("_sum_before") + so_far)
        added.append(total_col)
    if count_col:
        added.append(count_col)
    return out.select(*columns, *added)


def with_dense_id(df: DataFrame, order_by: list[str], id_col: str = "id", bucket: Column | None = None) -> DataFrame:
    """Number the rows 0.. in key order: every row once, those with null keys and repeated keys too.

    Which of the rows with one key comes first is not defined. Rows are numbered where they are sorted, so
    nothing is joined back.
    """
    columns = [c for c in df.columns if c != id_col]
    numbered = running(df, order_by, index_col=id_col, carry=columns, bucket=bucket)
    return numbered.select(*order_by, *[c for c in columns if c not in order_by], id_col)


def prefix_sum(df: DataFrame, order_by: list[str], value: str, within: list[str] = (),
               index_col: str = "position", total_col: str = "end_offset",
               carry: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """Running total of ``value`` in key order: each document's end offset."""
    return running(df, order_by, value, within, index_col, total_col, carry, bucket=bucket)


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42, position_col: str = "position") -> DataFrame:
    """Seeded global shuffle: a dense position per row, ordered by hash and then id."""
    keyed = df.withColumn("_key", shuffle_key(seed, F.col(id_col)))
    return with_dense_id(keyed, ["_key", id_col], position_col, hash_bucket(keyed)).drop("_key")


def contiguous_shards(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """Ceil-division ranges over a dense id; trailing shards may stay empty."""
    rows = df.agg(F.count("*").alias("_n")).scalar()
    size = F.greatest(int_div(rows + (shards - 1), shards), F.lit(1))
    return df.withColumn("shard", int_div(F.col(id_col), size))


def interleave_shards(df: DataFrame, shard_col: str, index_col: str, shards: int) -> DataFrame:
    """Original row number of row ``index`` in strided shard ``shard``."""
    return df.withColumn("row", F.col(shard_col) + F.col(index_col) * shards)


def batch_groups(df: DataFrame, order_by: list[str], size: int = 8) -> DataFrame:
    """Number rows in groups of ``size``, from 1, in key order."""
    return (with_dense_id(df, order_by, "_index")
            .withColumn("batch", int_div(F.col("_index"), size) + 1)
            .drop("_index"))
