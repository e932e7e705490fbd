"""Which packed instance is trained on at which step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .order import hash_bucket, int_div, running, shuffle_key

LOADER_SEED = 34521  # fixed value: the loader's base seed; epoch e uses base + e

# A replayed permutation lives in one Python worker per epoch at 4 bytes per instance.
MAX_REPLAY_INSTANCES = 1 << 29


def epoch_order(instances: DataFrame, epochs: int, seed: int = LOADER_SEED) -> DataFrame:
    """(epoch, rank, instance_id): a seeded order of all instances for each epoch.

    Ordered by a hash of (seed + epoch, instance), ranked by the distributed running count.
    """
    keyed = (instances.select("instance_id", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
             .withColumn("_key", shuffle_key(F.lit(seed) + F.col("epoch"), F.col("instance_id"))))
    return (running(keyed, ["_key", "instance_id"], within=["epoch"], index_col="rank",
                    bucket=hash_bucket(keyed))
            .select(F.col("epoch").cast("bigint").alias("epoch"), "rank", "instance_id"))


def replay_epoch_order(instances: DataFrame, epochs: int, seed: int = LOADER_SEED,
                       max_instances: int = MAX_REPLAY_INSTANCES) -> DataFrame:
    """The same table in the very order a NumPy PCG64 loader drew.

    A generator's shuffle is one sequential stream, so each epoch is drawn by one task and streamed
    out in batches; no rows go in. For a table beyond ``max_instances`` use ``epoch_order``.
    """
    rows = instances.count()
    if rows > max_instances:
        raise ValueError(f"{rows} instances are too many to replay in one task per epoch; use epoch_order")
    batch = 1 << 20

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for epoch in frame["epoch"].tolist():
                order = np.arange(rows, dtype=np.uint32)
                np.random.Generator(np.random.PCG64(seed=seed + epoch)).shuffle(order)
                for start in range(0, rows, batch):
                    part = order[start:start + batch]
                    yield pd.DataFrame({"epoch": epoch, "rank": np.arange(start, start + len(part)),
                                        "instance_id": part.astype(np.int64)})

    spark = instances.sparkSession
    return (spark.range(1, epochs + 1, numPartitions=epochs).withColumnRenamed("id", "epoch")
            .mapInPandas(draw, "epoch bigint, rank bigint, instance_id bigint"))


def training_schedule(order: DataFrame, instances: DataFrame, batch_size: int) -> DataFrame:
    """(step, epoch, position_in_batch, instance_id); what does not fill a batch is left out."""
    per_epoch = int_div(instances.agg(F.count("*")).scalar(), batch_size)
    return (order.withColumn("_spe", per_epoch)
            .where(F.col("rank") < F.col("_spe") * batch_size)
            .select(((F.col("epoch") - 1) * F.col("_spe") + int_div(F.col("rank"), batch_size)).alias("step"),
                    "epoch", (F.col("rank") % batch_size).alias("position_in_batch"), "instance_id"))


def step_epoch(step: Column, steps_per_epoch) -> Column:
    """struct(epoch, step_in_epoch) of a global step."""
    return F.struct((int_div(step, steps_per_epoch) + 1).alias("epoch"),
                    (step % steps_per_epoch).alias("step_in_epoch"))


def rank_stripes(schedule: DataFrame, world_size: int) -> DataFrame:
    """Data-parallel rank and slot of each row: rank r takes positions r, r + world_size, ..."""
    return (schedule.withColumn("dp_rank", F.col("position_in_batch") % world_size)
            .withColumn("dp_slot", int_div(F.col("position_in_batch"), world_size)))


def resume_offset(schedule: DataFrame, epoch: int, batches_processed: int, steps_per_epoch) -> DataFrame:
    """What is left of an epoch after its first batches."""
    return schedule.where((F.col("epoch") == epoch)
                          & (F.col("step") - (epoch - 1) * steps_per_epoch >= batches_processed))


def step_range(schedule: DataFrame, start: int, end: int) -> DataFrame:
    return schedule.where((F.col("step") >= start) & (F.col("step") < end))
