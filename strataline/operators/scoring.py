"""Aggregates over per-text label scores in long form (text_id, source, part, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The classifier's labels, in report order.
EMOTION_LABELS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]


def _grid(scores: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """One row per text with a map of its scores; the labels a text lacks count as zero.

    ``sum`` per label column combines map-side, so a source with most texts shuffles little.
    """
    sums = [F.coalesce(F.max(F.when(F.col("label") == label, F.col("score"))), F.lit(0.0)).alias(label)
            for label in labels]
    return scores.groupBy(*keep).agg(*sums)


def _unpivot(df: DataFrame, keep: list[str], labels: list[str], value: str) -> DataFrame:
    return df.unpivot(keep, labels, "label", value)


def mean_scores(scores: DataFrame, labels: list[str] = EMOTION_LABELS) -> DataFrame:
    """Mean score per part and label over the texts that were scored."""
    texts = _grid(scores, labels, ["text_id", "part"])
    means = texts.groupBy("part").agg(*[F.avg(label).alias(label) for label in labels])
    return _unpivot(means, ["part"], labels, "mean_score")


def score_contrast(scores: DataFrame, labels: list[str] = EMOTION_LABELS) -> DataFrame:
    """Think mean, response mean and their difference in points, per label."""
    means = mean_scores(scores, labels)

    def of(part: str):
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col("mean_score"))), F.lit(0.0)) * 100

    return (means.groupBy("label").agg(of("think").alias("think_pct"), of("response").alias("response_pct"))
            .withColumn("difference", F.col("response_pct") - F.col("think_pct")))


def dominant_counts(scores: DataFrame, labels: list[str] = EMOTION_LABELS) -> DataFrame:
    """Texts per part and highest-scoring label, with a row of zeros for a label nobody has.

    The earlier label wins a tie.
    """
    texts = _grid(scores, labels, ["text_id", "part"])
    best = F.greatest(*[F.col(label) for label in labels])
    dominant = None
    for label in labels:
        test = F.col(label) == best
        dominant = F.when(test, label) if dominant is None else dominant.when(test, label)
    counts = (texts.withColumn("_dominant", dominant).groupBy("part").agg(
        F.count("*").alias("texts"),
        *[F.count_if(F.col("_dominant") == label).alias(label) for label in labels]))
    return (_unpivot(counts, ["part", "texts"], labels, "count")
            .withColumn("pct", F.lit(100.0) * F.col("count") / F.greatest("texts", F.lit(1)))
            .drop("texts"))


def scores_by_source(scores: DataFrame, part: str, labels: list[str] = EMOTION_LABELS) -> DataFrame:
    """One row per source: its texts, those with this part, and the part's mean score of every label.

    Sources with most texts come first; one whose texts all lack the part keeps its row, without means.
    """
    here = F.col("part") == part
    best = [F.max(F.when(here & (F.col("label") == label), F.col("score"))).alias(label) for label in labels]
    texts = scores.groupBy("text_id", "source").agg(F.max(here).alias("_scored"), *best)
    means = [F.avg(F.when(F.col("_scored"), F.coalesce(label, F.lit(0.0)))).alias(label) for label in labels]
    return (texts.groupBy("source")
            .agg(F.count("*").alias("texts"), F.count_if("_scored").alias("scored"), *means)
            .orderBy(F.desc("texts"), "source"))
