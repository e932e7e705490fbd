"""Packing and schedule: goldens, a brute-force packer, invariants."""

import random

import pytest
from pyspark.sql import functions as F

from strataline.operators import packing as P, schedule as S
from strataline.operators.order import prefix_sum
from strataline.plans.lineage import LineageConfig, build_lineage


def bins_of(lengths, capacity):
    """Bins of document positions from the run form of the packer."""
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    ranks = {}
    for i, n in enumerate(lengths):
        ranks.setdefault(n, []).append(i)
    out = {}
    for length, first, docs, target, position, _ in P.best_fit_runs(list(counts.items()), capacity):
        for k in range(docs):
            out.setdefault(target, {})[position + k] = ranks[length][first + k]
    return [[b[i] for i in sorted(b)] for _, b in sorted(out.items())]


def plain_best_fit(lengths, capacity):
    """One document at a time; among equally tight bins the one that became so first."""
    bins, space, stamp = [], [], []
    for time, i in enumerate(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))):
        fits = [(space[b], stamp[b], b) for b in range(len(bins)) if space[b] >= lengths[i]]
        if fits:
            b = min(fits)[2]
        else:
            b = len(bins)
            bins.append([])
            space.append(capacity)
            stamp.append(0)
        bins[b].append(i)
        space[b] -= lengths[i]
        stamp[b] = time
    return bins


@pytest.mark.parametrize("lengths,capacity,expected", [
    ([5, 3, 8, 2, 6], 8, [[2], [4, 3], [0, 1]]),
    ([5, 5, 3, 3], 8, [[0, 2], [1, 3]]),
    ([4, 4, 4, 2, 2, 7], 8, [[5], [0, 1], [2, 3, 4]]),
])
def test_goldens(lengths, capacity, expected):
    assert bins_of(lengths, capacity) == expected


def test_against_plain_packer():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([7, 16, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        assert bins_of(lengths, capacity) == plain_best_fit(lengths, capacity)


def test_chunks(spark):
    docs = spark.createDataFrame([(0, 4), (1, 5), (2, 6), (3, 5)], "doc int, n bigint")
    sized = P.effective_length(P.assign_chunks(docs, ["doc"], "n", 10), "n", 10, 100)
    rows = sized.orderBy("doc").select("end_offset", "chunk", "effective_length").collect()
    assert [tuple(r) for r in rows] == [(4, 0, 4), (9, 0, 5), (15, 1, 5), (20, 1, 5)]
    tails = {r["chunk"]: r["dropped_tail"] for r in P.dropped_tail_tokens(sized, 10).collect()}
    assert tails == {0: 1, 1: 0}


def test_zero_length_documents_leave(spark):
    docs = spark.createDataFrame([(0, 0), (1, 5), (2, 0), (3, 5)], "doc int, n bigint")
    sized = P.effective_length(P.assign_chunks(docs, ["doc"], "n", 10), "n", 10, 100)
    assert sorted(r["doc"] for r in sized.collect()) == [1, 3]


def test_replayed_permutation(spark):
    ids = spark.range(8).withColumnRenamed("id", "instance_id")
    order = S.replay_epoch_order(ids, 1).orderBy("rank").collect()
    assert [r["instance_id"] for r in order] == [4, 6, 7, 0, 5, 1, 2, 3]
    with pytest.raises(ValueError):
        S.replay_epoch_order(ids, 1, max_instances=7)


@pytest.mark.parametrize("make", [S.epoch_order, S.replay_epoch_order])
def test_schedule(spark, make):
    ids = spark.range(7).withColumnRenamed("id", "instance_id")
    rows = S.training_schedule(make(ids, 2), ids, 3).collect()
    assert sorted({(r["step"], r["epoch"]) for r in rows}) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    for epoch in (1, 2):
        seen = [r["instance_id"] for r in rows if r["epoch"] == epoch]
        assert len(seen) == len(set(seen)) == 6
    assert all(sorted(r["position_in_batch"] for r in rows if r["step"] == s) == [0, 1, 2] for s in range(4))


def skewed(spark, n=3000):
    """A third of all documents share one source and one length."""
    return spark.range(n).select(
        F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.when(F.col("id") % 3 == 0, F.lit(64)).otherwise(F.col("id") * 37 % 90 + 1).cast("bigint").alias("n"))


def test_lineage_invariants(spark):
    docs = skewed(spark)
    cfg = LineageConfig(sequence_length=64, chunk_tokens=9973, instances_per_batch=4)
    made = build_lineage(docs, "doc", "source", "n", cfg)
    packed = made.instance_documents.collect()
    assert len(packed) == len({r["doc_id"] for r in packed}) == 3000
    by_bin = {}
    for r in packed:
        by_bin.setdefault(r["instance_id"], []).append(r["position_in_instance"])
    assert sorted(by_bin) == list(range(len(by_bin)))
    assert all(sorted(p) == list(range(len(p))) for p in by_bin.values())
    assert made.packed_instances.where("packed_tokens > 64").count() == 0
    stats = made.stats.first()
    assert stats["instances"] == len(by_bin) and stats["packed_tokens"] + stats["padding"] == 64 * len(by_bin)
    assert made.training_steps.groupBy("step").count().where("count <> 4").count() == 0


def test_partition_invariance(spark):
    docs = skewed(spark)
    results = []
    for parts in (1, 7):
        ends = prefix_sum(docs.repartition(parts), ["n", "doc"], "n")
        results.append(sorted(map(tuple, ends.collect())))
    assert results[0] == results[1]
    assert [r[2] for r in results[0]] == list(range(3000))


def test_running_total_with_a_hot_group(spark):
    docs = skewed(spark)
    rows = prefix_sum(docs, ["doc"], "n", within=["source"]).collect()
    totals = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["doc"])):
        i, t = totals.get(r["source"], (0, 0))
        t += r["n"]
        assert (r["position"], r["end_offset"]) == (i, t)
        totals[r["source"]] = (i + 1, t)
