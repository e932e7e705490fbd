"""From conversations to prompt, reasoning and response records, and the length gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M, text as X
from .order import with_dense_id


def _split_last_assistant(conversations: DataFrame) -> DataFrame:
    """Rows with a non-empty last assistant message, split once."""
    return (conversations.withColumn("_answer", M.last_assistant(F.col("messages")))
            .where(F.col("_answer").isNotNull())
            .withColumn("_parts", X.split_think(F.col("_answer"))))


def extract_two_part(conversations: DataFrame, key: str, source: str = "source",
                     dense_ids: bool = True) -> DataFrame:
    """Last assistant message split in two, with the last user message before it."""
    out = _split_last_assistant(conversations).select(
        key, F.col(source).alias("dataset_source"),
        M.last_user_before(F.col("messages")).alias("user_prompt"),
        F.col("_parts.think").alias("think_text"),
        F.col("_parts.response").alias("response_text"))
    return with_dense_id(out, [key]) if dense_ids else out


def extract_combined(conversations: DataFrame, key: str, source: str = "source",
                     dense_ids: bool = True) -> DataFrame:
    """As above with all the earlier messages as the prompt and the number of assistant turns."""
    out = _split_last_assistant(conversations).select(
        key, F.col(source).alias("dataset_source"),
        M.prior_context(F.col("messages")).alias("user_prompt"),
        F.col("_parts.think").alias("think_text"),
        F.col("_parts.response").alias("response_text"),
        M.num_assistant_turns(F.col("messages")).alias("num_turns"))
    return with_dense_id(out, [key]) if dense_ids else out


def extract_for_scoring(conversations: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Both parts of the last assistant message; rows where both are empty leave."""
    return (_split_last_assistant(conversations)
            .where((F.col("_parts.think") != "") | (F.col("_parts.response") != ""))
            .select(key, source, F.col("_parts.think").alias("think_text"),
                    F.col("_parts.response").alias("response_text")))


def last_assistant_rows(messages: DataFrame, conv: str, keep: list[str] = ()) -> DataFrame:
    """The same selection over one-row-per-message tables, with no conversation built in memory.

    ``max_by`` combines map-side, so a conversation with very many messages costs one row per task.
    """
    is_assistant = F.col("role") == "assistant"
    picked = (messages.where(is_assistant).groupBy(conv, *keep)
              .agg(F.max_by("content", "turn").alias("content")))
    return picked.where(F.coalesce(F.col("content"), F.lit("")) != "")


def measure_tokens(records: DataFrame, token_length: Callable[[Column], Column], max_length: int) -> tuple[DataFrame, DataFrame]:
    """(safe, measured) records with a ``token_count``.

    Texts of no more bytes than the limit are safe, as no tokeniser gives more tokens than bytes: they
    leave by a filter and are never tokenised, so a Python tokeniser in ``token_length`` sees only the
    others. Their count is 0 when empty, else null.
    """
    limit = max_length - 2  # room for two special tokens
    text = X.concat_record_text(F.col("user_prompt"), F.col("think_text"), F.col("response_text"))
    sized = records.withColumn("_text", text).withColumn("_chars", F.length("_text"))
    short = F.octet_length("_text") <= limit
    needs = F.coalesce((F.col("_chars") > 0) & ~short, F.lit(False))
    safe = sized.where(~needs).withColumn("token_count", F.when(F.col("_chars") == 0, F.lit(0)).cast("bigint"))
    counted = F.greatest(token_length(F.col("_text")).cast("bigint"), F.lit(1))  # 0 is for empty texts
    measured = sized.where(needs).withColumn("token_count", counted)
    return safe.drop("_text", "_chars"), measured.drop("_text", "_chars")


def split_measured(measured: DataFrame, key: str, max_length: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of measured records; dropped ones with their reason."""
    limit = max_length - 2
    tokens = F.col("token_count")
    reason = F.when(tokens == 0, "empty").when(tokens > limit, "too_long")
    kept = measured.where(reason.isNull()).drop("token_count")
    dropped = (measured.withColumn("reason", reason).where(F.col("reason").isNotNull())
               .select(F.col(key).alias("id"), "dataset_source", "reason", "token_count"))
    return kept, dropped


def length_gate(records: DataFrame, key: str, token_length: Callable[[Column], Column],
                max_length: int) -> tuple[DataFrame, DataFrame]:
    """Split records into (kept, dropped) by token count of the joined text."""
    safe, measured = measure_tokens(records, token_length, max_length)
    return split_measured(safe.unionByName(measured), key, max_length)


def renumber(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Fresh dense ids for what a filter left."""
    return with_dense_id(df.drop(id_col) if id_col != key else df, [key], id_col)


def drop_reason_counts(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("reason").agg(F.count("*").alias("count")).orderBy("reason")


def truncated_length(length: Column, limit: int) -> Column:
    return F.least(length, F.lit(limit))


def trainable_tokens(messages: DataFrame, conv: str, length_fn: Callable[[Column], Column]) -> DataFrame:
    """All tokens and assistant tokens of each conversation; only the latter are trained on."""
    tokens = length_fn(F.col("content"))
    return messages.groupBy(conv).agg(
        F.sum(tokens).alias("tokens"),
        F.sum(F.when(F.col("role") == "assistant", tokens).otherwise(0)).alias("trainable_tokens"))


def resume_skip(work: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows not finished yet."""
    return work.join(finished.select(key), key, "left_anti")


def check_resume_config(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """(setting, wanted, saved) rows that differ; a non-empty result forbids resuming."""
    names = [c for c in wanted.columns if c in saved.columns]

    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("setting"), F.col(n).cast("string").alias(value)) for n in names])
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    both = long(wanted, "wanted").join(long(saved, "saved"), "setting")
    return both.where(~F.col("wanted").eqNullSafe(F.col("saved")))
