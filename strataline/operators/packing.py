"""Chunks of a token stream and best-fit packing of their documents into sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .order import int_div, prefix_sum

RUN_SCHEMA = ("chunk bigint, effective_length bigint, first_rank bigint, docs bigint, "
              "bin bigint, first_position bigint, space_left bigint")


def assign_chunks(docs: DataFrame, order_by: list[str], length: str, chunk_tokens: int) -> DataFrame:
    """Position, end offset and chunk of each document in the concatenated stream."""
    return with_chunk(prefix_sum(docs, order_by, length), chunk_tokens)


def with_chunk(ends: DataFrame, chunk_tokens: int) -> DataFrame:
    """A document belongs to the chunk that holds its last token."""
    return (ends.where(F.col("end_offset") > 0)
            .withColumn("chunk", int_div(F.col("end_offset") - 1, chunk_tokens)))


def effective_length(chunked: DataFrame, length: str, chunk_tokens: int, sequence_length: int) -> DataFrame:
    """Length as the packer sees it: cut at the chunk start and at the sequence length.

    In a running total the previous document's end is ``end - length``, so a document starts at
    that offset or, for the first one of a chunk, at the chunk start. No window is needed.
    """
    start = F.greatest(F.col("end_offset") - F.col(length), F.col("chunk") * chunk_tokens)
    return (chunked.withColumn("start_in_chunk", start)
            .withColumn("effective_length",
                        F.least(F.col("end_offset") - F.col("start_in_chunk"), F.lit(sequence_length)))
            .where(F.col("effective_length") > 0))


def dropped_tail_tokens(chunked: DataFrame, chunk_tokens: int) -> DataFrame:
    """Tokens after the last document end of each chunk that has a document."""
    ends = chunked.groupBy("chunk").agg(F.count("*").alias("documents"), F.max("end_offset").alias("last_end"))
    total = chunked.agg(F.max("end_offset")).scalar()
    limit = F.least((F.col("chunk") + 1) * chunk_tokens, total)
    return ends.withColumn("dropped_tail", limit - F.col("last_end"))


def best_fit_runs(histogram: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Pack ``(length, count)`` pairs, longest first, each into the fullest bin it still fits.

    Documents of one length follow each other, so a bin with free space s takes ``s // length`` of
    them in a row: after each it is still the tightest fit. Bins with equal space are used first
    come, first served. Returns rows (length, first rank, documents, bin, first position); a rank
    counts the documents of that length.
    """
    waiting: dict[int, deque[int]] = {}
    spaces: list[int] = []
    free: list[int] = []
    filled: list[int] = []
    rows: list[list[int]] = []
    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                target = len(free)
                free.append(capacity)
                filled.append(0)
            else:
                space = spaces[at]
                target = waiting[space].popleft()
                if not waiting[space]:
                    del waiting[space], spaces[at]
            taken = min(free[target] // length, count - rank)
            rows.append([length, rank, taken, target, filled[target]])
            rank += taken
            filled[target] += taken
            free[target] -= taken * length
            if free[target]:
                if free[target] not in waiting:
                    waiting[free[target]] = deque()
                    insort(spaces, free[target])
                waiting[free[target]].append(target)
    for row in rows:
        row.append(free[row[3]])
    return rows


def _chunk_packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["effective_length"].tolist(), pdf["docs"].tolist()))
        out = pd.DataFrame(best_fit_runs(pairs, capacity),
                           columns=["effective_length", "first_rank", "docs", "bin", "first_position", "space_left"])
        out.insert(0, "chunk", int(pdf["chunk"].iloc[0]))
        return out

    return pack


def _spread(per_chunk: DataFrame) -> DataFrame:
    tasks = int(per_chunk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return per_chunk.repartition(tasks, "chunk")


def packing_runs(sized: DataFrame, sequence_length: int) -> DataFrame:
    """Bin assignments of each chunk, as runs of equally long documents.

    The packer needs only how many documents of each length a chunk holds. That histogram is
    aggregated map-side and has at most ``sequence_length`` rows per chunk, which bounds the group
    that reaches Python whatever the data size; chunks are packed independently.
    """
    histogram = sized.groupBy("chunk", "effective_length").agg(F.count("*").alias("docs"))
    # a chunk costs time and few bytes, so the number of tasks is fixed and not merged by size
    histogram = _spread(histogram)
    return materialise(histogram.groupBy("chunk").applyInPandas(_chunk_packer(sequence_length), RUN_SCHEMA), "packing")


def number_instances(runs: DataFrame) -> DataFrame:
    """First instance id of each chunk. One row per chunk of ``chunk_tokens`` tokens."""
    bins = runs.groupBy("chunk").agg((F.max("bin") + 1).alias("bins"))
    earlier = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return bins.select("chunk", "bins", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("first_instance"))


def instance_ids(runs: DataFrame) -> DataFrame:
    """All instance ids. The few chunk rows are spread before each becomes thousands of ids."""
    return (_spread(number_instances(runs))
            .select(F.explode(F.sequence(F.col("first_instance"), F.col("first_instance") + F.col("bins") - 1))
                    .alias("instance_id")))


def pack_documents(sized: DataFrame, sequence_length: int, runs: DataFrame | None = None) -> DataFrame:
    """(instance_id, position, position_in_instance, chunk, effective_length) per packed document."""
    runs = packing_runs(sized, sequence_length) if runs is None else runs
    slots = (runs.join(number_instances(runs), "chunk")
             .select("chunk", "effective_length", (F.col("first_instance") + F.col("bin")).alias("instance_id"),
                     "first_rank", "first_position",
                     F.explode(F.sequence(F.lit(0), F.col("docs") - 1)).alias("_step"))
             .select("chunk", "effective_length", "instance_id",
                     (F.col("first_rank") + F.col("_step")).alias("_rank"),
                     (F.col("first_position") + F.col("_step")).alias("position_in_instance")))
    same_length = W.partitionBy("chunk", "effective_length").orderBy("position")
    ranked = (sized.select("chunk", "effective_length", "position")
              .withColumn("_rank", F.row_number().over(same_length).cast("bigint") - 1))
    return (ranked.join(slots, ["chunk", "effective_length", "_rank"])
            .select("instance_id", "position", "position_in_instance", "chunk", "effective_length"))


def instance_summary(packed: DataFrame, docs: DataFrame, length: str) -> DataFrame:
    """Documents and tokens of each instance, by original and by effective length."""
    return (packed.join(docs.select("position", length), "position")
            .groupBy("instance_id")
            .agg(F.count("*").alias("num_documents"), F.sum(length).alias("total_tokens"),
                 F.sum("effective_length").alias("packed_tokens")))


def packing_stats(runs: DataFrame, sequence_length: int, instances_per_batch: int, epochs: int) -> DataFrame:
    """Instances, packed tokens, padding, documents, steps and instances left over per epoch."""
    per_bin = runs.groupBy("chunk", "bin").agg(F.sum("docs").alias("docs"), F.max("space_left").alias("space"))
    totals = per_bin.agg(F.count("*").alias("instances"), F.sum("docs").alias("documents"),
                         F.sum("space").alias("padding"))
    steps = int_div(F.col("instances"), instances_per_batch)
    return totals.select(
        "instances", "documents", "padding",
        (F.col("instances") * sequence_length - F.col("padding")).alias("packed_tokens"),
        steps.alias("steps_per_epoch"), (steps * epochs).alias("total_steps"),
        (F.col("instances") - steps * instances_per_batch).alias("dropped_per_epoch"))


def document_boundaries(docs: DataFrame, order_by: list[str], length: str, chunk_tokens: int) -> DataFrame:
    """(start, end) of each document inside its chunk's token file."""
    chunked = assign_chunks(docs, order_by, length, chunk_tokens)
    base = F.col("chunk") * chunk_tokens
    return chunked.select(
        *order_by, "position", "chunk",
        F.greatest(F.col("end_offset") - F.col(length) - base, F.lit(0)).alias("start"),
        (F.col("end_offset") - base).alias("end"))
