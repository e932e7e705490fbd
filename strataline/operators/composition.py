"""What a model saw: lineage joins and source composition of step ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .order import int_div


def lineage_join(steps: DataFrame, instance_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """Step, instance and document side by side. Equi-joins on evenly spread keys."""
    return (steps.join(instance_documents.select("instance_id", "doc_id", "position_in_instance"), "instance_id")
            .join(documents.select("doc_id", "source_dataset", "token_count"), "doc_id"))


def steps_to_docs(lineage: DataFrame, start: int, end: int) -> DataFrame:
    """Documents seen in ``[start, end)``; the filter reaches the step table's scan."""
    return (lineage.where((F.col("step") >= start) & (F.col("step") < end))
            .select("step", "instance_id", "doc_id", "source_dataset", "token_count"))


def checkpoint_composition(lineage: DataFrame, total_steps, interval: int = 1000) -> DataFrame:
    """Distinct documents and tokens per step range and source.

    A document seen twice in a range counts once but brings its tokens twice. One grouping over
    all ranges, first by document, so that a source with most of the rows is spread over tasks.
    """
    start = int_div(F.col("step"), interval) * interval
    seen = (lineage.groupBy(start.alias("step_start"), "source_dataset", "doc_id")
            .agg(F.sum("token_count").alias("tokens")))
    return (seen.groupBy("step_start", "source_dataset")
            .agg(F.count("*").alias("num_documents"), F.sum("tokens").alias("total_tokens"))
            .select("step_start", F.least(F.col("step_start") + interval, total_steps).alias("step_end"),
                    "source_dataset", "num_documents", "total_tokens")
            .orderBy("step_start", F.desc("total_tokens"), "source_dataset"))


def step_composition(lineage: DataFrame, step: int) -> DataFrame:
    """Sources of one step by rows."""
    return (lineage.where(F.col("step") == step).groupBy("source_dataset")
            .agg(F.count("*").alias("count")))


def half_composition(lineage: DataFrame, total_steps, tolerance: float = 0.15) -> DataFrame:
    """Tokens of each source in both halves of training, their ratio, and whether it is off."""
    first = F.col("step") < int_div(total_steps, 2)
    tokens = F.col("token_count")
    halves = lineage.groupBy("source_dataset").agg(
        F.sum(F.when(first, tokens).otherwise(0)).alias("first_half"),
        F.sum(F.when(~first, tokens).otherwise(0)).alias("second_half"))
    return _judged_halves(halves, tolerance)


def _judged_halves(halves: DataFrame, tolerance: float) -> DataFrame:
    ratio = F.when(F.col("second_half") > 0, F.try_divide(F.col("first_half"), F.col("second_half"))
                   ).otherwise(F.lit(float("inf")))
    return (halves.withColumn("ratio", ratio)
            .withColumn("flagged", F.abs(F.col("ratio") - 1.0) > tolerance)
            .orderBy("source_dataset"))


def instance_sources(instance_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """(instance_id, source_dataset, documents, tokens): what each packed instance holds.

    Documents are shuffled once, whatever the number of epochs; the rest of a composition works on instances.
    """
    return (instance_documents.select("instance_id", "doc_id").join(documents.select("doc_id", "source_dataset", "token_count"), "doc_id")
            .groupBy("instance_id", "source_dataset").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens")))


def checkpoint_composition_of(steps: DataFrame, sources: DataFrame, total_steps, interval: int = 1000) -> DataFrame:
    """``checkpoint_composition`` from steps and ``instance_sources``, for documents that lie in one instance each.

    An instance that a range sees twice brings its documents once and its tokens twice, so instances are counted by
    range first and no row of a document meets an epoch.
    """
    start = int_div(F.col("step"), interval) * interval
    seen = steps.groupBy(start.alias("step_start"), "instance_id").agg(F.count("*").alias("times")).join(sources, "instance_id")
    return (seen.groupBy("step_start", "source_dataset")
            .agg(F.sum("documents").alias("num_documents"), F.sum(F.col("times") * F.col("tokens")).alias("total_tokens"))
            .select("step_start", F.least(F.col("step_start") + interval, total_steps).alias("step_end"),
                    "source_dataset", "num_documents", "total_tokens")
            .orderBy("step_start", F.desc("total_tokens"), "source_dataset"))


def half_composition_of(steps: DataFrame, sources: DataFrame, total_steps, tolerance: float = 0.15) -> DataFrame:
    """``half_composition`` from steps and ``instance_sources``."""
    first = F.col("step") < int_div(total_steps, 2)
    times = steps.groupBy("instance_id").agg(F.count_if(first).alias("_first"), F.count_if(~first).alias("_second"))
    tokens = times.join(sources, "instance_id").groupBy("source_dataset").agg(
        F.sum(F.col("_first") * F.col("tokens")).alias("first_half"), F.sum(F.col("_second") * F.col("tokens")).alias("second_half"))
    return _judged_halves(tokens, tolerance)


def sources_seen(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that any step has seen."""
    return sources.join(steps.select("instance_id"), "instance_id", "left_semi").select("source_dataset").distinct()
