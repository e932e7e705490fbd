"""Writers for the tables the operators produce."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import safe_name
from ..operators.checks import check_aligned
from ..plans.lineage import Lineage

DROPPED_SCHEMA = "id bigint, dataset_source string, reason string, token_count bigint"


def write_extracted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dropped(df: DataFrame, path: str) -> None:
    """The audit table, with its columns even when no row was dropped."""
    df.select("id", "dataset_source", "reason", "token_count").write.mode("overwrite").parquet(path)


def write_lineage(lineage: Lineage, path: str) -> None:
    """Four tables and their totals. Sorting by the lookup key inside range partitions gives every file a narrow
    min/max range, so a step or instance lookup skips all but a few files."""
    layout = {
        "documents": ["doc_id"],
        "packed_instances": ["instance_id"],
        "instance_documents": ["instance_id", "position_in_instance"],
        "training_steps": ["step", "position_in_batch"],
    }
    for name, keys in layout.items():
        table = getattr(lineage, name)
        (table.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
         .write.mode("overwrite").parquet(f"{path}/{name}"))
    lineage.stats.write.mode("overwrite").parquet(f"{path}/stats")


def write_composition_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_source(df: DataFrame, path: str, source: str = "dataset_source") -> None:
    """One sub-folder per source, named safely. The source column itself stays, so two sources that
    share a safe name remain apart. The rebalance gathers small sources and splits large ones, so a
    source with most of the rows is written by many tasks."""
    named = df.withColumn("safe_source", safe_name(F.col(source)))
    named.hint("rebalance", "safe_source").write.mode("overwrite").partitionBy("safe_source").parquet(path)


def write_embeddings(vectors: DataFrame, metadata: DataFrame, path: str, key: str = "id") -> None:
    """Refuses to write when vectors and metadata do not match row for row."""
    finding = check_aligned(vectors, metadata, key).first()
    if not finding["ok"]:
        raise ValueError(f"vectors and metadata differ: {finding.asDict()}")
    vectors.write.mode("overwrite").parquet(path)


def write_extremes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_run_config(df: DataFrame, path: str) -> None:
    """One row of parameters as JSON, read back by ``check_resume_config``."""
    df.coalesce(1).write.mode("overwrite").json(path)
