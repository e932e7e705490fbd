"""Dataset profiles: distributions, exact length summaries, think coverage, system prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import messages as M, text as X


def explode_messages(conversations: DataFrame, *keep: str) -> DataFrame:
    """One row per message. Pruned to the fields used, as the Parquet reader prunes nested columns."""
    return (conversations.select(*keep, F.posexplode("messages").alias("turn", "message"))
            .select(*keep, "turn", F.col("message.role").alias("role"),
                    F.col("message.content").alias("content")))


def distribution(df: DataFrame, key: str, bar: bool = False) -> DataFrame:
    """Rows and share per value, largest first, with the total and the number of groups.

    The total comes from the grouped rows, not from a second pass over the data.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    whole = counts.agg(F.struct(F.sum("count").alias("total"), F.count("*").alias("groups"))).scalar()
    out = (counts.withColumn("_whole", whole)
           .select(key, "count", (F.lit(100.0) * F.col("count") / F.col("_whole.total")).alias("pct"),
                   F.col("_whole.total").alias("total"), F.col("_whole.groups").alias("groups")))
    if bar:
        out = out.withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("pct") / 2).cast("int")))
    return out.orderBy(F.desc("count"), key)


def _nearest_rank(q: float) -> Column:
    return F.round((F.col("_total") - 1) * F.lit(q)) + 1


def length_summary(df: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """count, mean, median, p5, p95, min and max of an integer measure.

    Quantiles are exact (nearest rank; the median interpolates). The rows are first reduced to a
    histogram of distinct lengths, map-side, so what is shuffled and ordered is the number of
    distinct lengths and not the number of rows, however large one group is.
    """
    by = list(by)
    histogram = df.groupBy(*by, value.alias("_value")).agg(F.count("*").alias("_n"))
    weight = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)
    group = W.partitionBy(*by)
    ranked = (histogram.withColumn("_n", weight)
              .withColumn("_cum", F.sum("_n").over(
                  group.orderBy("_value").rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("_total", F.sum("_n").over(group)))

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("_n") > 0) & (F.col("_cum") >= rank), F.col("_value")))

    middle = (F.col("_total") - 1) / 2
    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("count"),
        (F.sum(F.col("_value") * F.col("_n")).cast("double") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"),
        ((at(F.floor(middle) + 1) + at(F.ceil(middle) + 1)) / F.lit(2.0)).alias("median"),
        at(_nearest_rank(0.05)).alias("p5"),
        at(_nearest_rank(0.95)).alias("p95"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
    )


def quantile(df: DataFrame, value: Column, q: float, by: list[str] = (), method: str = "nearest") -> DataFrame:
    """One quantile per group: ``nearest`` (default), or Spark's ``disc`` and ``cont``."""
    if method == "nearest":
        by = list(by)
        group = W.partitionBy(*by)
        histogram = (df.where(value.isNotNull()).groupBy(*by, value.alias("_value"))
                     .agg(F.count("*").alias("_n"))
                     .withColumn("_cum", F.sum("_n").over(
                         group.orderBy("_value").rowsBetween(W.unboundedPreceding, 0)))
                     .withColumn("_total", F.sum("_n").over(group)))
        hit = F.when(F.col("_cum") >= _nearest_rank(q), F.col("_value"))
        return histogram.groupBy(*by).agg(F.min(hit).alias("quantile"))
    name = {"disc": "percentile_disc", "cont": "percentile_cont"}[method]
    measured = df.withColumn("_value", value)
    return measured.groupBy(*by).agg(
        F.expr(f"{name}({q}D) WITHIN GROUP (ORDER BY _value)").alias("quantile"))


def turn_summary(conversations: DataFrame) -> DataFrame:
    return length_summary(conversations, M.turn_count(F.col("messages")))


def length_summary_by_role(messages: DataFrame) -> DataFrame:
    return length_summary(messages, X.content_length(F.col("content")), ["role"]).orderBy("role")


def think_rate(messages: DataFrame) -> DataFrame:
    """Assistant messages, those with both tags, and their share."""
    return (messages.where(F.col("role") == "assistant")
            .agg(F.count("*").alias("total_asst"),
                 F.count_if(X.has_think_tags(F.col("content"))).alias("think_count"))
            .withColumn("pct", F.lit(100.0) * F.col("think_count") / F.greatest("total_asst", F.lit(1))))


def think_length_summary(messages: DataFrame) -> DataFrame:
    """Length summary of the think part and of the response part of tagged assistant messages."""
    tagged = messages.where((F.col("role") == "assistant") & X.has_think_tags(F.col("content")))
    parts = X.split_think_lengths(F.col("content"))
    measured = tagged.select(F.explode(F.array(
        F.struct(F.lit("think").alias("part"), parts["think_block_len"].alias("length")),
        F.struct(F.lit("response").alias("part"), parts["response_len"].alias("length")),
    )).alias("m")).select("m.part", "m.length")
    return length_summary(measured, F.col("length"), ["part"]).drop("min", "max")


def mentioning(messages: DataFrame, pattern: str) -> DataFrame:
    return messages.where(X.mentions(F.col("content"), pattern))


def matched_rows_by_source(messages: DataFrame, pattern: str, source: str = "source") -> DataFrame:
    return (mentioning(messages, pattern).groupBy(source).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), source))


def conversation_stats(messages: DataFrame, conv: str, turn: str = "turn") -> DataFrame:
    """Turns, assistant turns, characters and first messages by role, one row per conversation.

    For tables with one row per message: everything combines map-side, and no conversation is built.
    """
    role, content = F.col("role"), F.col("content")

    def chars(name: str) -> Column:
        return F.coalesce(F.sum(F.when(role == name, X.content_length(content))), F.lit(0))

    def first(name: str) -> Column:
        return F.coalesce(F.min_by(content, F.when(role == name, F.col(turn))), F.lit(""))

    return messages.groupBy(conv).agg(
        F.count("*").alias("turns"), F.count_if(role == "assistant").alias("assistant_turns"),
        chars("user").alias("user_chars"), chars("assistant").alias("assistant_chars"),
        first("user").alias("first_user"), first("assistant").alias("first_assistant"))


def semi_join_convs(conversations: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Conversations with a matched message. The matches are reduced to their keys first, so one
    conversation with very many of them weighs one row."""
    return conversations.join(matched.select(key).distinct(), key, "left_semi")


def system_prompt_stats(messages: DataFrame, conv: str) -> DataFrame:
    """Conversations, those with a system message and their share, distinct system texts."""
    is_system = F.col("role") == "system"
    per_conv = messages.groupBy(conv).agg(F.max(is_system).alias("_system"))
    prompts = messages.where(is_system).agg(F.count_distinct("content")).scalar()
    return (per_conv.agg(F.count("*").alias("conversations"), F.count_if("_system").alias("with_system"))
            .select("conversations", "with_system", prompts.alias("unique_prompts"),
                    (F.lit(100.0) * F.col("with_system") / F.greatest("conversations", F.lit(1))).alias("pct")))


def system_prompts_by_source(messages: DataFrame, conv: str, source: str = "source") -> DataFrame:
    return (messages.where(F.col("role") == "system").groupBy(source)
            .agg(F.count_distinct(conv).alias("convs")).orderBy(F.desc("convs"), source))


def top_values(df: DataFrame, column: str, k: int = 15, preview: int = 120) -> DataFrame:
    return (df.groupBy(column).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), column).limit(k)
            .withColumn("preview", X.preview_text(F.col(column), preview, one_line=True)))


def n_unique(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Distinct values, null counted as one of them."""
    null_seen = F.coalesce(F.max(F.col(column).isNull().cast("bigint")), F.lit(0))
    return df.groupBy(*by).agg((F.count_distinct(column) + null_seen).alias("n_unique"))


def distinct_sources(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def filter_sources(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose source contains any pattern, ignoring case; patterns are literal text."""
    return df.where(X.contains_any(F.col(column), patterns))


def filter_null_or_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) == ""))


def token_stats(df: DataFrame, length: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("documents"), F.sum(length).alias("total_tokens"),
        F.avg(length).alias("mean_tokens"), F.max(length).alias("max_tokens"),
        F.min(length).alias("min_tokens"))
