"""Mixtures, statistics and text verdicts against plain Python."""

import datetime
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strataline.operators import mixing as X, runs as R, statistics as S, textfilters as T, vectors as V


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 50), st.sampled_from([0, 0.1, 0.33, 1, 2.5])), min_size=1),
       st.one_of(st.none(), st.integers(0, 200)))
def test_quotas_add_up(datasets, total):
    sizes, weights = {k: v[0] for k, v in datasets.items()}, {k: v[1] for k, v in datasets.items()}
    whole = sum(Fraction(str(w)) * sizes[k] for k, w in weights.items())
    if total and not whole:
        with pytest.raises(ValueError):
            X.apportion(sizes, weights, total)
        return
    quota = X.apportion(sizes, weights, total)
    assert sum(quota.values()) == (int(whole + Fraction(1, 2)) if total is None else total)
    for k in quota:
        claim = Fraction(str(weights[k])) * sizes[k] * (1 if total is None or not whole else Fraction(total) / whole)
        assert abs(quota[k] - claim) < 1 or total is None and abs(quota[k] - claim) <= 1


def test_mixture_totals_and_copies(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "a").when(F.col("id") < 900, "b").when(F.col("id") < 995, "c").alias("set"), F.lit("wide").alias("copy_of"))
    mixed = X.mix_datasets(df, "set", "id", {"a": 0.25, "b": 2.5, "c": 1, "none": 3}, total=333).collect()
    assert len(mixed) == 333 and {r["set"] for r in mixed} == {"a", "b", "c"}
    quota = X.apportion({"a": 700, "b": 200, "c": 95}, {"a": 0.25, "b": 2.5, "c": 1, "none": 3}, 333)
    assert Counter(r["set"] for r in mixed) == {k: v for k, v in quota.items() if v}
    per_row = Counter((r["set"], r["id"]) for r in mixed)
    for name in "abc":  # whole copies differ by at most one
        seen = [n for (s, _), n in per_row.items() if s == name]
        assert max(seen) - (min(seen) if len(seen) == {"a": 700, "b": 200, "c": 95}[name] else 0) <= 1
    assert X.mix_datasets(df.limit(0), "set", "id", {"a": 1.5}).count() == 0
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, X.mix_datasets(df.repartition(7), "set", "id", {"a": 0.25, "b": 2.5, "c": 1, "none": 3}, total=333).collect()))


def test_upsampling_deals_completions_in_turn(spark):
    prompts = spark.range(101).select("id", F.lit("s").alias("set"))
    answers = spark.range(303).select((F.col("id") % 101).alias("id"), F.col("id").alias("answer")).where("id <> 5")
    rows = X.upsample(prompts, answers, "id", "set", "answer", {"s": 4.3}).collect()
    assert len(rows) == int(Fraction("4.3") * 101)
    used = Counter((r["id"], r["answer"]) for r in rows if r["answer"] is not None)
    for i in range(101):
        counts = [used[(i, a)] for a in range(i, 303, 101)]
        assert i == 5 or max(counts) - min(counts) <= 1
    assert all(r["answer"] is None for r in rows if r["id"] == 5)


def test_best_verified_answers(spark):
    rows = [("p", i, i % 3 == 0, i // 2) for i in range(2000)] + [("q", 5000, None, 1), ("r", 6000, True, 1)]
    df = spark.createDataFrame(rows, "prompt string, id long, ok boolean, score long")
    got = X.verified_only(df, "prompt", "id", F.col("ok"), [F.desc("score")], 3).orderBy("prompt", "rank").collect()
    assert [(r["prompt"], r["id"], r["rank"], r["n_answers"], r["n_passed"]) for r in got] == [
        ("p", 1998, 1, 2000, 667), ("p", 1995, 2, 2000, 667), ("p", 1992, 3, 2000, 667), ("r", 6000, 1, 1, 1)]


def test_statistics_merge(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 100_000, 20_000)
    rows = [(int(v), f"s{i % 3}" if i % 7 else None, int(v) % 5000) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "n long, set string, ident long")
    whole = S.dataset_statistics(df, ["set"], F.col("n"), F.col("ident"))
    halves = [S.dataset_statistics(df.where(F.col("ident") % 2 == i), ["set"], F.col("n"), F.col("ident")) for i in (0, 1)]
    merged = S.merge_statistics(*halves)
    exact = ["dimension", "value", "n_rows", "total", "least", "greatest"]
    assert sorted(map(str, whole.select(exact).collect())) == sorted(map(str, merged.select(exact).collect()))
    for table in (whole, merged):
        for r in S.read_statistics(table).collect():
            mine = [x for x in rows if r["dimension"] == "total" or x[1] == r["value"]]
            assert abs(r["n_distinct"] - len({x[2] for x in mine})) <= 0.05 * len({x[2] for x in mine})
            ordered = np.sort([x[0] for x in mine])
            for q in (25, 50, 75):
                assert abs(np.searchsorted(ordered, r[f"q{q}"]) / len(ordered) - q / 100) < 0.03
    assert S.read_statistics(S.dataset_statistics(df.limit(0), ["set"], F.col("n"), F.col("ident"))).count() == 0


@pytest.mark.parametrize("text,state,blocks", [
    (None, "none", 0), ("", "none", 0), ("plain", "none", 0), ("<think>a</think>b.", "complete", 1), ("<think>a</think> b", "cut_off", 1),
    ("<think>a", "unclosed", 0), ("a</think>b.", "unopened", 0), ("<think>a<think>b</think>c.", "nested", 1), ("<think>a</think> \n", "unanswered", 1),
    ("<think>a</think>b<think>c</think>done!", "complete", 2), ("<think>a</think></think>b.", "unopened", 1), ("x" * 100_000 + "<think>", "unclosed", 0)])
def test_reasoning_states(spark, text, state, blocks):
    row = T.incomplete_reasoning_filter(texts(spark, [text]), "text").first()
    assert (row["state"], row["blocks"], row["kept"]) == (state, blocks, state in ("none", "complete"))


def brute_repetition(text, k):
    w = (text or "").encode().split()
    n = len(w)
    longest, covered = 0, set()
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                m = 0
                while max(i, j) + m < n and w[i + m] == w[j + m]:
                    m += 1
                best = max(best, m)
        longest = max(longest, best)
        if best >= k:
            covered.update(range(i, i + best))
    period = next((p for p in range(1, n // 2 + 1) if w[:n - p] == w[p:]), None)
    return n, longest, len(covered), period


def test_repetition_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    cases = [None, "", "one", "a a", "a b a b a", "a b c a b c a b", "é è é è", "x y x y", "a " * 50]
    cases += [" ".join(rng.choice(list("abc"), rng.integers(2, 60))) for _ in range(60)]
    cases += [" ".join([*rng.choice(list("abcdefgh"), 30), *(list("lmnopqrstu") * 2), *rng.choice(list("abcdefgh"), 9)])]
    got = {r["id"]: tuple(r)[1:] for r in T.repetition_profile(texts(spark, cases), "id", "text", 3).collect()}
    assert got == {i: brute_repetition(c, 3) for i, c in enumerate(cases)}


def test_repetition_of_a_long_text(spark):
    words = [str(i) for i in np.random.default_rng(2).integers(0, 10**9, 20_000)]
    row = T.repetition_filter(texts(spark, [" ".join(words + words[:5000])]), "id", "text").first()
    assert (row["n_words"], row["longest_repeat"], row["repeated_words"], row["period"], row["kept"]) == (25_000, 5000, 10_000, None, False)


def test_scripts(spark):
    cases = [None, "", "12 !", "plain words", "mixed wоrd", "слово word слово", "漢字漢字とか", "한국어", "αβγ"]
    rows = {r["id"]: r for r in T.char_class_filter(texts(spark, cases), "text", ("Latin",)).collect()}
    assert [rows[i]["dominant"] for i in range(9)] == [None, None, None, "Latin", "Latin", "Cyrillic", "Han", "Hangul", "Greek"]
    assert [rows[i]["mixed_words"] for i in range(9)] == [0, 0, 0, 0, 1, 0, 1, 0, 0]
    assert [rows[i]["kept"] for i in range(9)] == [True, True, True, True, False, False, False, False, False]


def test_scripts_match_brute_force(spark):
    """Letters are taken out run by run, not matched one by one; numerals of a script are no letters."""
    rng = np.random.default_rng(3)
    kinds = {"Latin": "aZ\u00e9\u017f", "Greek": "\u03b1\u03a9", "Cyrillic": "\u043e\u0416", "Han": "\u6f22\U00020000", "Hangul": "\ud55c", "Thai": "\u0e01"}
    other, none = "\u0531\u10d0", "\u2167\u2160\u3007 -\u0301\u0e31\U0001f600\n"  # letters of no listed script; no letters
    script = {c: s for s, letters in kinds.items() for c in letters}
    alphabet = list("".join(kinds.values()) + other + none) + ["a", " "] * 4
    cases = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(600)]
    judged = T.char_class_filter(texts(spark, cases), "text", ("Latin",))
    for r in judged.collect():
        text = cases[r["id"]]
        words = "".join(c if c in script or c in other else " " for c in text).split()
        expected = [sum(map(len, words)), *[sum(script.get(c) == s for c in text) for s in kinds]]
        assert [r["n_letters"], *[r[f"n_{s.lower()}"] for s in kinds]] == expected, text
        assert r["mixed_words"] == sum(len({script[c] for c in w if c in script}) > 1 for w in words), text
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("regexp_count") <= 1


def test_topics_split_hot_terms(spark):
    terms = spark.createDataFrame([("t", "hot", 1.0), ("t", "rare", 2.0), ("u", "hot", 0.5), ("v", "absent", 1.0)], "topic string, term string, weight double")
    rows = texts(spark, ["Hot hot"] * 300 + ["rare hot"] + ["nothing", None, ""])
    got = {(r["id"], r["topic"]): r["score"] for r in T.topic_scores(rows, "id", "text", terms).collect()}
    hot, rare = np.log1p(304 / 301), np.log1p(304)
    assert len(got) == 602 and np.isclose(got[(0, "t")], 2 * hot) and np.isclose(got[(300, "t")], hot + 2 * rare) and np.isclose(got[(300, "u")], hot / 2)
    judged = {r["id"]: (r["topic"], r["kept"]) for r in T.topic_filter(rows, "id", "text", terms, 1.0).collect()}
    assert len(judged) == 304 and judged[300] == ("t", False) and judged[301] == (None, True) and judged[302] == (None, True)


def test_dates(spark):
    cases = ["on 2024-02-30 and 2024-02-29", "5 March 2024; May 7, 2021", "In June 2020.", "31 June 2020", None, "12024-01-01"]
    rows = {r["id"]: r["d"] for r in texts(spark, cases).select("id", T.mentioned_dates(F.col("text")).alias("d")).collect()}
    day = datetime.date
    assert rows == {0: [day(2024, 2, 29)], 1: [day(2024, 3, 5), day(2021, 5, 7)], 2: [day(2020, 6, 1)], 3: [], 4: [], 5: []}


def test_licences(spark):
    cases = [None, "no word of it", "Released under the MIT License.", "License: MIT or GPL-3.0", "license: MIT and GPL-3.0", "All rights reserved.",
             "Licensed under CC BY-NC 4.0.", "license: who knows", "MIT license\nall rights reserved", "license: GPL-2.0 with Classpath-exception or Apache-2.0"]
    rows = [r["licence"] for r in T.license_filter(texts(spark, cases), "text").orderBy("id").collect()]
    assert rows == ["unclear", "unclear", "allowed", "allowed", "refused", "refused", "refused", "unclear", "refused", "allowed"]


def test_rolling_means_keep_to_their_window(spark):
    def smooth(values, divisor, centered=False):
        df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run string, step long, value double")
        return [r["smoothed"] for r in R.rolling_mean(df, "value", ["step"], ["run"], divisor, centered).orderBy("step").collect()]

    assert smooth([1, float("inf"), 2, 3, 4, 5], 3) == [1, float("inf"), float("inf"), 2.5, 3.5, 4.5]
    assert np.allclose(smooth([1e16] + [0.01] * 9, 5)[2:], 0.01, rtol=1e-12)
    long = np.random.default_rng(0).normal(size=5000)
    want = [long[max(0, i - 2499):i + 1].mean() for i in range(5000)]  # blocks of more than one chunk
    assert np.allclose(smooth(long, 2), want)


def test_neighbour_index_skips_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5))
    data = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(480, 5))
    data[:60] = data[0]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>").repartition(5)
    seen = V.visited_pairs(df, "id", "v", 4, 20).first()
    assert seen["visited"] < 0.5 * seen["all_pairs"] == 0.5 * 480 ** 2
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, np.inf)
    rows = V.knn_graph(df, "id", "v", 4, 20).collect()
    assert len(rows) == 480 * 4
    for r in rows:
        assert abs(np.sort(distance[r["id"]])[r["rank"] - 1] - r["distance"]) < 1e-9
        assert abs(distance[r["id"], r["neighbor_id"]] - r["distance"]) < 1e-9
    assert V.knn_graph(df.limit(0), "id", "v").count() == 0


def test_neighbour_questions_are_not_broadcast(spark):
    """A block asks in many cells, far more than the planner takes the table for."""
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(50)], "id long, v array<double>")
    plan = V.knn_graph(df, "id", "v", 4, 20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
