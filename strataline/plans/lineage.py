"""From documents with token counts to a queryable training lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import messages as M
from ..operators import composition, extract as E, packing, schedule
from ..operators.order import hash_bucket, shuffle_key
from ..session import materialise


@dataclass(frozen=True)
class LineageConfig:
    """Fixed values of the training run the lineage describes; all can be changed."""

    sequence_length: int = 32_768
    chunk_tokens: int = 536_870_912
    instances_per_batch: int = 32
    epochs: int = 2
    shuffle_seed: int = 42
    loader_seed: int = schedule.LOADER_SEED
    replay: bool = False  # True: the loader's own PCG64 order, see replay_epoch_order


@dataclass(frozen=True)
class Lineage:
    documents: DataFrame
    packed_instances: DataFrame
    instance_documents: DataFrame
    training_steps: DataFrame
    stats: DataFrame

    def joined(self) -> DataFrame:
        return composition.lineage_join(self.training_steps, self.instance_documents, self.documents)

    def sources(self) -> DataFrame:
        return composition.instance_sources(self.instance_documents, self.documents)

    def total_steps(self):
        return self.stats.select("total_steps").scalar()


def documents_from_conversations(conversations: DataFrame, id_col: str, source_col: str,
                                 token_length: Callable[[Column], Column],
                                 sequence_length: int = LineageConfig.sequence_length) -> DataFrame:
    """Lineage input: conversations with an assistant message, their lengths cut at the sequence.

    ``token_length`` maps the message array to a count. Write the result before building on it, so
    that the texts are measured once.
    """
    trained = conversations.where(M.has_assistant(F.col("messages")))
    return trained.select(id_col, source_col,
                          E.truncated_length(token_length(F.col("messages")), sequence_length)
                          .cast("bigint").alias("token_count"))


def assistant_report(conversations: DataFrame) -> DataFrame:
    """Conversations in all, kept and removed by the assistant filter."""
    return (conversations.agg(F.count("*").alias("conversations"),
                              F.count_if(M.has_assistant(F.col("messages"))).alias("kept"))
            .withColumn("removed", F.col("conversations") - F.col("kept")))


def build_lineage(docs: DataFrame, id_col: str, source_col: str, length_col: str,
                  cfg: LineageConfig = LineageConfig()) -> Lineage:
    """Shuffle, cut into chunks, pack, order the epochs, schedule.

    One shuffle of (hash, id, source, length) gives both the shuffled position and the running
    total; from there on every step works on narrow rows of integers.
    """
    narrow = docs.select(F.col(id_col).alias("hf_id"), F.col(source_col).alias("source_dataset"),
                         F.col(length_col).cast("bigint").alias("token_count"))
    keyed = narrow.withColumn("_key", shuffle_key(cfg.shuffle_seed, F.col("hf_id")))
    ends = materialise(packing.prefix_sum(keyed, ["_key", "hf_id"], "token_count", carry=["source_dataset"],
                                          bucket=hash_bucket(keyed)), "ends")
    documents = ends.select(F.col("position").alias("doc_id"), F.col("hf_id").cast("string").alias("hf_id"),
                            "source_dataset", "token_count")
    chunked = packing.with_chunk(ends, cfg.chunk_tokens)
    sized = packing.effective_length(chunked, "token_count", cfg.chunk_tokens, cfg.sequence_length)
    runs = packing.packing_runs(sized, cfg.sequence_length)
    packed = packing.pack_documents(sized, cfg.sequence_length, runs)
    instance_documents = packed.select("instance_id", F.col("position").alias("doc_id"), "position_in_instance")
    packed_instances = packing.instance_summary(packed, ends, "token_count")
    ids = packing.instance_ids(runs)
    order = (schedule.replay_epoch_order if cfg.replay else schedule.epoch_order)(ids, cfg.epochs, cfg.loader_seed)
    steps = schedule.training_schedule(order, ids, cfg.instances_per_batch)
    stats = packing.packing_stats(runs, cfg.sequence_length, cfg.instances_per_batch, cfg.epochs)
    return Lineage(documents, packed_instances, instance_documents, steps, stats)


def read_lineage(spark: SparkSession, path: str) -> Lineage:
    """The tables ``write_lineage`` left: queries on them skip files by step, instance or document."""
    tables = {name: spark.read.parquet(f"{path}/{name}")
              for name in ("documents", "packed_instances", "instance_documents", "training_steps", "stats")}
    return Lineage(**tables)


def composition_by_checkpoint(lineage: Lineage, interval: int = 1000) -> DataFrame:
    return composition.checkpoint_composition_of(lineage.training_steps, lineage.sources(), lineage.total_steps(), interval)
