"""Dataset mixing: weighted mixtures with exact totals, upsampling with different completions, the best of several answers."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise
from .order import running, shuffle_key

_CUT_BITS = 16  # the histogram of hash keys has this many bits: 65,536 rows a dataset


def apportion(sizes: Mapping[str, int], weights: Mapping[str, float], total: int | None = None) -> dict[str, int]:
    """Rows for each dataset by the largest remainder, so that they add up to ``total`` exactly.

    A dataset's claim is weight times size. Without ``total`` the claims' sum is rounded half up; with it they are
    scaled. What the whole parts leave over goes to the largest fractions, ties by name. A dataset without rows gets
    none. Weights are read as decimal numbers: 0.1 is a tenth.
    """
    claims = {name: Fraction(str(weights[name])) * sizes.get(name, 0) for name in weights}
    if any(c < 0 for c in claims.values()):
        raise ValueError("weights must not be negative")
    whole = sum(claims.values())
    if total is None:
        total = int(whole + Fraction(1, 2))
    elif whole:
        claims = {name: c * total / whole for name, c in claims.items()}
    elif total:
        raise ValueError("nothing to draw from")
    quota = {name: int(c) for name, c in claims.items()}
    left = total - sum(quota.values())
    for name in sorted(claims, key=lambda n: (quota[n] - claims[n], n))[:left]:
        quota[name] += 1
    return quota


def mix_datasets(df: DataFrame, dataset: str, key: str, weights: Mapping[str, float], seed: int = 42,
                 total: int | None = None) -> DataFrame:
    """The rows of a weighted mixture, with a column ``copy`` from 0.

    Each named dataset gives exactly its quota (see ``apportion``): every row as many whole copies as fit, and the rest
    drawn without replacement by a seeded hash of ``key``, which must be unique within a dataset. Datasets that are not
    named, and rows without one, are left out. ``shuffle_rows`` puts a mixture in random order.

    One pass counts datasets by the hash's top bits; that tells in which bucket each draw ends. Only the keys of these
    buckets are ranked. The wide rows are read once more and never shuffled: a dataset's draw is a comparison with the
    last drawn key. What is broadcast has one row for each named dataset.
    """
    spark = df.sparkSession
    named = df.where(F.col(dataset).isin(list(weights))).select("*", shuffle_key(seed, F.col(key)).alias("_key"))
    bucket = F.shiftright("_key", 60 - _CUT_BITS)
    counts = materialise(named.groupBy(F.col(dataset).alias("_dataset"), bucket.alias("_bucket")).agg(F.count("*").alias("_rows")), "mix-counts")
    sizes = {r["_dataset"]: r["n"] for r in counts.groupBy("_dataset").agg(F.sum("_rows").alias("n")).collect()}  # one row each
    quota = apportion(sizes, weights, total)
    plan = spark.createDataFrame([(name, q // sizes[name], q % sizes[name]) for name, q in quota.items() if q] or [("", 0, 0)],
                                 "_dataset string, _whole bigint, _rest bigint")
    plan = plan.select(F.col("_dataset").cast(df.schema[dataset].dataType).alias("_dataset"), "_whole", "_rest")
    before = F.sum("_rows").over(W.partitionBy("_dataset").orderBy("_bucket")) - F.col("_rows")
    cuts = (counts.withColumn("_before", before).join(F.broadcast(plan), "_dataset")
            .where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_rows")))
            .select("_dataset", "_bucket", (F.col("_rest") - F.col("_before")).alias("_take")))
    drawn = named.select(F.col(dataset).alias("_dataset"), bucket.alias("_bucket"), "_key", F.col(key).alias("_id")).join(
        F.broadcast(cuts), ["_dataset", "_bucket"])
    ranked = drawn.withColumn("_rank", F.row_number().over(W.partitionBy("_dataset").orderBy("_key", "_id")))
    last = materialise(ranked.where(F.col("_rank") == F.col("_take")).select("_dataset", F.struct("_key", "_id").alias("_last")), "mix-cuts")
    wide = named.join(F.broadcast(plan.join(last, "_dataset", "left")), named[dataset] == F.col("_dataset"))
    in_rest = F.coalesce(F.struct(F.col("_key"), F.col(key).alias("_id")) <= F.col("_last"), F.lit(False))
    copies = F.col("_whole") + in_rest.cast("bigint")
    listed = F.when(copies > 0, F.sequence(F.lit(0).cast("bigint"), copies - 1)).otherwise(F.array().cast("array<bigint>"))
    return wide.select(*[named[c] for c in df.columns], F.explode(listed).alias("copy"))


def upsample(prompts: DataFrame, completions: DataFrame, key: str, dataset: str, completion: str,
             factors: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Prompts repeated with different completions: (``dataset``, ``key``, repeat, ``completion``).

    A dataset of n prompts and factor f gives floor(n * f) rows exactly: in the order of a seeded hash, prompt i gets
    floor((i + 1) * f) - floor(i * f) repeats, so factors need not be whole. A prompt's completions are dealt in turn, in
    their own order, so each is used equally often or once more. Datasets without a factor keep factor 1. Prompts
    without a completion keep their repeats with a null one. ``key`` must be unique among the prompts.
    """
    factor = F.lit(1).cast("decimal(18,6)")
    for name, value in factors.items():
        factor = F.when(F.col(dataset) == name, F.lit(str(value)).cast("decimal(18,6)")).otherwise(factor)
    keyed = prompts.select(dataset, key, shuffle_key(seed, F.col(key)).alias("_key"))
    placed = running(keyed, ["_key", key], within=[dataset], index_col="_at")
    upto = [F.floor((F.col("_at") + i).cast("decimal(20,0)") * factor).cast("bigint") for i in (0, 1)]
    counted = placed.select(dataset, key, (upto[1] - upto[0]).alias("_repeats"))
    repeated = counted.where("_repeats > 0").select(
        dataset, key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_repeats") - 1)).alias("repeat"))
    order = W.partitionBy(key).orderBy(completion)
    dealt = completions.select(key, completion, (F.row_number().over(order) - 1).cast("bigint").alias("_turn"))
    sizes = completions.groupBy(key).agg(F.count("*").alias("_n"))
    asked = repeated.join(sizes, key, "left").withColumn("_turn", F.pmod("repeat", "_n"))
    return asked.join(dealt, [key, "_turn"], "left").select(dataset, key, "repeat", completion)


def verified_only(answers: DataFrame, prompt: str, key: str, passed: Column, order: list[Column], k: int = 1) -> DataFrame:
    """The best ``k`` verified answers of each prompt with their rank, the prompt's answers and its pass rate.

    ``passed`` says whether an answer was verified; a null verdict is none. ``order`` puts better answers first; ties go
    by ``key``, which must be unique. Prompts without a verified answer have no row. Every map task passes on its own best k
    of a prompt, so a prompt with a third of all answers sends little; answers and verdicts are counted map-side too.
    """
    judged = answers.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    rates = judged.groupBy(prompt).agg(F.count("*").alias("n_answers"), F.sum(F.col("_passed").cast("bigint")).alias("n_passed"))
    best = W.partitionBy(prompt).orderBy(*order, key)
    kept = judged.where("_passed").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("_passed")
    return kept.join(rates.withColumn("pass_rate", F.col("n_passed") / F.col("n_answers")), prompt)
