"""Model probes: which identity does each checkpoint claim?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import classify as C, text as X
from .order import running


def explode_responses(results: DataFrame) -> DataFrame:
    """(file_key, sample, raw): one row per response of a result file."""
    return results.select("file_key", F.posexplode("responses").alias("sample", "raw"))


def probe_entries(responses: DataFrame, own_names: list[tuple[str, str]] = ()) -> DataFrame:
    """Adds answer, think and identity to each response row (its text in ``raw``)."""
    return (responses.withColumn("answer", X.extract_answer(F.col("raw")))
            .withColumn("think", X.extract_think(F.col("raw")))
            .withColumn("identity", C.classify_identity(F.col("answer"), list(own_names))))


def registry_join(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Checkpoints that have a result, in registry order."""
    return registry.join(results, "file_key", "inner").orderBy("ord")


def pending_checkpoints(registry: DataFrame, results: DataFrame) -> DataFrame:
    return registry.join(results.select("file_key"), "file_key", "left_anti")


def identity_counts(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """(checkpoint, identity, count) with zeros filled in; only identities that occur.

    ``rank`` orders the identities by their total, then by name.
    """
    cells = entries.groupBy("file_key", "identity").agg(F.count("*").alias("count"))
    totals = cells.groupBy("identity").agg(F.sum("count").alias("total"))
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "identity")))
    active = registry.join(cells.select("file_key").distinct(), "file_key", "left_semi")
    # identities are a handful of labels: one array of them travels to every checkpoint
    labels = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "identity")))).scalar()
    grid = active.select("ord", "file_key", F.explode(labels).alias("_l")).select(
        "ord", "file_key", F.col("_l.identity").alias("identity"), F.col("_l.rank").alias("rank"))
    return (grid.join(cells, ["file_key", "identity"], "left")
            .select("ord", "file_key", "rank", "identity", F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy("ord", "rank"))


def max_cell_count(entries: DataFrame) -> DataFrame:
    return (entries.groupBy("file_key", "identity").agg(F.count("*").alias("count"))
            .agg(F.max("count").alias("max_count")))


def stage_spans(checkpoints: DataFrame, order_by: str = "ord", stage: str = "stage") -> DataFrame:
    """Runs of equal stage in registry order: (stage, start, end), 0-based positions.

    Inside a run, the position among all checkpoints and the position among those of the stage grow
    together, so their difference names the run.
    """
    overall = running(checkpoints, [order_by], index_col="_i", carry=[stage])
    islands = running(overall, [order_by], within=[stage], index_col="_j", carry=["_i"])
    return (islands.groupBy(stage, (F.col("_i") - F.col("_j")).alias("_island"))
            .agg(F.min("_i").alias("start"), F.max("_i").alias("end"))
            .drop("_island").orderBy("start"))
