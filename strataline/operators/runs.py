"""Training-run catalogues and metric histories in long form (run, step, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import classify as C, text as X
from ..session import materialise
from .order import int_div, running

# Words looked for in configuration, metric and summary names.
INTERESTING_CONFIG_KEYS = ["_CLASS_", "run_name", "model_name", "task", "stage", "phase",
                           "training_type", "model_type", "experiment", "group"]
CONFIG_WORDS = ["class", "stage", "phase", "type", "task", "mode"]
EVAL_WORDS = ["eval", "val", "perplexity", "accuracy", "benchmark", "ppl", "acc"]
SUMMARY_WORDS = ["loss", "eval", "val", "perplexity", "ppl", "acc", "benchmark"]


def keyword_any(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    return df.where(X.contains_any(F.col(column), words))


def run_groups(runs: DataFrame, group: Column, name: str = "group") -> DataFrame:
    """Number of runs per state, name pattern, tag set, category, ..."""
    return runs.groupBy(group.alias(name)).agg(F.count("*").alias("runs")).orderBy(name)


def run_overview(runs: DataFrame, history: DataFrame, run: str = "id", history_run: str = "run_id") -> DataFrame:
    """One line per run: tags, sizes of configuration and summary, and whether it has a history."""
    seen = history.select(F.col(history_run).alias(run)).distinct().withColumn("_seen", F.lit(True))

    def keys(column: str) -> Column:
        return F.coalesce(F.size(F.json_object_keys(column)), F.lit(0)).cast("bigint")

    return runs.join(seen, run, "left").select(
        run, "name", "state", X.tag_key(F.col("tags")).alias("tags"), keys("config").alias("config_key_count"),
        keys("summary").alias("summary_key_count"), F.coalesce("_seen", F.lit(False)).alias("has_history"))


def config_bucket_groups(runs: DataFrame, count_col: str) -> DataFrame:
    bucketed = runs.withColumn("bucket", C.config_bucket(F.col(count_col)))
    return bucketed.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("runs"))


def metrics_of(history: DataFrame) -> DataFrame:
    return history.select("metric").distinct()


def metric_groups(history: DataFrame, shown: int = 10) -> DataFrame:
    """Distinct metrics per prefix, and the first few names of each."""
    metrics = metrics_of(history).withColumn("prefix", X.metric_prefix(F.col("metric")))
    firsts = W.partitionBy("prefix").orderBy("metric")
    return (metrics.withColumn("_rank", F.row_number().over(firsts)).groupBy("prefix")
            .agg(F.count("*").alias("metrics"),
                 F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rank") <= shown, F.col("metric")))), ", ")
                 .alias("first_metrics"))
            .orderBy("prefix"))


def metric_select(history: DataFrame) -> DataFrame:
    """(kind, metric): accuracy and perplexity metrics, and the one loss metric to plot."""
    metrics = metrics_of(history)
    name = F.col("metric")
    current = ~name.contains("v2")
    kind = (F.when(name.contains("(accuracy)") & current, "accuracy")
            .when(name.startswith("eval/lm/") & name.endswith("/PPL") & current, "ppl"))
    picked = metrics.select(kind.alias("kind"), "metric").where(F.col("kind").isNotNull())
    exact = F.min(F.when(name == "train/CE loss", name))
    any_loss = F.min(F.when(F.lower(name).contains("loss"), name))
    loss = (metrics.agg(F.coalesce(exact, any_loss).alias("metric"))
            .where(F.col("metric").isNotNull()).select(F.lit("loss").alias("kind"), "metric"))
    return picked.unionByName(loss)


def richest_run(history: DataFrame, run_order: str = "run_id", enough: int | None = None) -> DataFrame:
    """The run with most metrics; the first one on ties.

    With ``enough``, the search stops at the first run with more metrics than that.
    """
    counts = history.groupBy(run_order).agg(F.count_distinct("metric").alias("metrics"))
    best = F.min_by(F.struct(run_order, "metrics"), F.struct((-F.col("metrics")).alias("fewer"), run_order))
    first = F.min_by(F.struct(run_order, "metrics"), F.when(F.col("metrics") > (enough or 0), F.col(run_order)))
    stopped = F.max("metrics") > (enough if enough is not None else 2**62)
    return counts.agg(F.when(stopped, first).otherwise(best).alias("r")).select("r.*")


def drop_na(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all the columns are present; NaN counts as missing."""
    return df.dropna(subset=columns)


def union_histories(frames: list[DataFrame]) -> DataFrame:
    """Wide histories with differing columns, one below the other."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def pivot_history(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide (run, step, one column per named metric)."""
    return history.groupBy("run_id", "step").pivot("metric", metrics).agg(F.first("value"))


CHUNK = 1024  # rows whose running sums one task makes


def rolling_mean(df: DataFrame, value: str, order_by: list[str], series: list[str],
                 divisor: int, centered: bool = False, name: str = "smoothed") -> DataFrame:
    """Rolling mean with window ``max(1, rows // divisor)`` of each series, partial at the ends.

    The width depends on the data, which a Spark window frame cannot say. So each series is cut into blocks as wide as
    its window: a window is then the end of one block and the beginning of the next (or lies in one block at an end of
    the series), and its sum is one sum up to the block's end plus one from the next block's start. Nothing is subtracted, so an
    infinity or a huge value touches only the windows that hold it. The two sums have two levels, chunks of 1,024 rows and chunk
    totals in a block, and are fetched by equi-joins on (series, position): a series that holds most of the rows spreads like any other.
    """
    present = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    placed = running(df.where(present), order_by, within=series, index_col="_i", carry=[value], count_col="_n")
    cut = (placed.withColumn("_w", F.greatest(int_div(F.col("_n"), divisor), F.lit(1)))
           .withColumn("_b", int_div(F.col("_i"), F.col("_w")))
           .withColumn("_c", int_div(F.col("_i") - F.col("_b") * F.col("_w"), CHUNK)))
    chunk = [*series, "_b", "_c"]

    def so_far(window, column=value, last: int = 0) -> Column:
        return F.sum(column).over(window.rowsBetween(W.unboundedPreceding, last))

    inside = W.partitionBy(*chunk)
    rows = materialise(cut.select("*", so_far(inside.orderBy("_i")).alias("_up"), so_far(inside.orderBy(F.desc("_i"))).alias("_down")), "rolling")
    block = W.partitionBy(*series, "_b")
    totals = rows.where(F.col("_i") == F.col("_b") * F.col("_w") + F.col("_c") * CHUNK).select(*chunk, F.col("_down").alias("_total"))
    totals = totals.select(*chunk, F.coalesce(so_far(block.orderBy("_c"), "_total", -1), F.lit(0)).alias("_before"),
                           F.coalesce(so_far(block.orderBy(F.desc("_c")), "_total", -1), F.lit(0)).alias("_after"))
    rows = rows.join(totals, chunk).withColumn("_up", F.col("_before") + F.col("_up")).withColumn("_down", F.col("_down") + F.col("_after"))
    ahead = int_div(F.col("_w") - 1, 2) if centered else F.lit(0)
    framed = (rows.withColumn("_hi", F.least(F.col("_i") + ahead, F.col("_n") - 1))
              .withColumn("_lo", F.greatest(F.col("_i") + ahead - F.col("_w") + 1, F.lit(0))))
    starts = rows.select(*series, F.col("_i").alias("_lo"), F.col("_down").alias("_from_lo"))
    framed = framed.join(starts, [*series, "_lo"])
    if centered:
        ends = rows.select(*series, F.col("_i").alias("_hi"), F.col("_up").alias("_to_hi"))
        framed = framed.join(ends, [*series, "_hi"])
    else:
        framed = framed.withColumn("_to_hi", F.col("_up"))
    first, last = int_div(F.col("_lo"), F.col("_w")), int_div(F.col("_hi"), F.col("_w"))
    # in one block a window begins where the block does, or ends where the series does
    total = (F.when(first != last, F.col("_from_lo") + F.col("_to_hi"))
             .when(F.col("_lo") == first * F.col("_w"), F.col("_to_hi")).otherwise(F.col("_from_lo")))
    return framed.select(*series, *order_by, value, (total / (F.col("_hi") - F.col("_lo") + 1)).alias(name))


def prefix_select(names: DataFrame, column: str, prefixes: list[str], ends: int = 3) -> DataFrame:
    """Names per prefix with their number, keeping the first and the last few of each in name order."""
    stage = F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        stage = F.when(F.col(column).startswith(prefix), prefix).otherwise(stage)
    staged = names.select(stage.alias("prefix"), column).where(F.col("prefix").isNotNull())
    ranked = running(staged, [column], within=["prefix"], index_col="rank", count_col="count")
    return (ranked.where((F.col("rank") < ends) | (F.col("rank") >= F.col("count") - ends))
            .select("prefix", "count", "rank", column))
