"""Validation frames: one row per finding, so that a job can alert on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The accepted open intervals of a full-size build.
EXPECTED_RANGES = {
    "instances": (500_000, 1_000_000),
    "steps_per_epoch": (15_000, 35_000),
    "total_steps": (30_000, 70_000),
}


def check_row_count(df: DataFrame, expected: int, tolerance: int = 1000) -> DataFrame:
    return (df.agg(F.count("*").alias("actual"))
            .select(F.lit(expected).cast("bigint").alias("expected"), "actual",
                    (F.abs(F.col("actual") - expected) < tolerance).alias("ok")))


def check_expected_total(df: DataFrame, expected: int) -> DataFrame:
    return (df.agg(F.count("*").alias("actual"))
            .select(F.lit(expected).cast("bigint").alias("expected"), "actual",
                    (F.lit(expected) - F.col("actual")).alias("difference")))


def check_range(stats: DataFrame, ranges: dict[str, tuple[int, int]] = EXPECTED_RANGES) -> DataFrame:
    """One row per named measure: is it inside its open interval?"""
    rows = F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).cast("bigint").alias("value"),
                 ((F.col(name) > low) & (F.col(name) < high)).alias("ok"))
        for name, (low, high) in ranges.items()])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def docs_in_many_instances(instance_documents: DataFrame) -> DataFrame:
    return (instance_documents.groupBy("doc_id")
            .agg(F.count_distinct("instance_id").alias("instances"))
            .where(F.col("instances") > 1))


def orphan_documents(documents: DataFrame, instance_documents: DataFrame) -> DataFrame:
    """Documents in no instance."""
    return documents.join(instance_documents.select("doc_id"), "doc_id", "left_anti")


def check_one_instance(documents: DataFrame, instance_documents: DataFrame) -> DataFrame:
    """Documents in all, packed, orphaned, and in more than one instance."""
    per_doc = (instance_documents.groupBy("doc_id")
               .agg(F.count_distinct("instance_id").alias("instances")))
    joined = documents.select("doc_id").join(per_doc, "doc_id", "left")
    return joined.agg(
        F.count("*").alias("documents"), F.count("instances").alias("packed"),
        F.count_if(F.col("instances").isNull()).alias("orphans"),
        F.count_if(F.col("instances") > 1).alias("in_many_instances"))


def check_source_counts(df: DataFrame, source: str, expected: DataFrame) -> DataFrame:
    """Actual beside expected rows per source, sources of either side included."""
    actual = df.groupBy(source).agg(F.count("*").alias("actual"))
    return (actual.join(expected.select(source, "expected"), source, "full_outer")
            .select(source, F.coalesce("actual", F.lit(0)).alias("actual"),
                    F.coalesce("expected", F.lit(0)).alias("expected"))
            .withColumn("difference", F.col("expected") - F.col("actual")))


def check_aligned(vectors: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """Rows on both sides, and keys that only one of them has."""
    left = vectors.select(key, F.lit(1).alias("_v"))
    right = metadata.select(key, F.lit(1).alias("_m"))
    return (left.join(right, key, "full_outer")
            .agg(F.count("_v").alias("vectors"), F.count("_m").alias("metadata"),
                 F.count_if(F.col("_v").isNull() | F.col("_m").isNull()).alias("unmatched"))
            .withColumn("ok", (F.col("vectors") == F.col("metadata")) & (F.col("unmatched") == 0)))
