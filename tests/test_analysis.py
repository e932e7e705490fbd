"""PCA against NumPy, rolling means against pandas, sampling, configurations, models."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.operators import configs as G, extract as E, models as D, profile as P, runs as R, sampling as S, vectors as V
from strataline.sources import writers as W


def matrix(spark, n=400, width=12, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, width)) * np.linspace(3, 0.5, width) + 2
    rows = [(i, "big" if i % 3 else f"s{i % 5}", data[i].astype(np.float32).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, source string, v array<float>"), data.astype(np.float32).astype(float)


def numpy_pca(data, k):
    centred = data - data.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    ratio = s**2 / (s**2).sum()
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return ratio[:k], (vt * signs[:, None])[:k], centred


def test_pca_matches_numpy(spark):
    df, data = matrix(spark)
    model = V.pca_fit(df.repartition(5), "v", 4)
    rows = model.orderBy("pc").collect()
    ratio, parts, centred = numpy_pca(data, 4)
    assert np.allclose([r["explained_ratio"] for r in rows], ratio)
    assert np.allclose([r["component"] for r in rows], parts, atol=1e-8)
    scores = V.pca_project(df, model, "id", "v").collect()
    got = np.zeros((400, 4))
    for r in scores:
        got[r["id"], r["pc"] - 1] = r["score"]
    assert np.allclose(got, centred @ parts.T, atol=1e-8)


def test_joined_projection_agrees(spark, monkeypatch):
    df, _ = matrix(spark)
    model = V.pca_by_source(df, "v", "source", 2)
    fast = {(r["id"], r["pc"]): r["score"] for r in V.pca_project(df, model, "id", "v", "source").collect()}
    monkeypatch.setattr(V, "MODEL_BYTES", 0)
    slow = {(r["id"], r["pc"]): r["score"] for r in V.pca_project(df, model, "id", "v", "source").collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[k] - slow[k]) < 1e-9 for k in fast)


def test_pca_by_source(spark, monkeypatch):
    monkeypatch.setattr(V, "GRAM_BUFFER_BYTES", 1)  # partial matrices leave after every batch
    df, data = matrix(spark)
    small = df.where((F.col("source") == "big") | (F.col("id") < 20))
    model = V.pca_by_source(small, "v", "source", 10)
    counts = {r["grp"]: (r["n"], r["k"]) for r in model.groupBy("grp").agg(
        F.max("n_rows").alias("n"), F.count("*").alias("k")).collect()}
    sizes = {r["source"]: r["count"] for r in small.groupBy("source").count().collect()}
    assert counts == {s: (n, min(10, n - 1)) for s, n in sizes.items() if n >= 3}
    big = [i for i in range(400) if i % 3]
    ratio, _, _ = numpy_pca(data[big], 10)
    got = [r["explained_ratio"] for r in model.where("grp = 'big'").orderBy("pc").collect()]
    assert np.allclose(got, ratio)


def test_knn_matches_brute_force(spark):
    df, data = matrix(spark, 150)
    rows = V.knn_graph(df, "id", "v", k=6, block=20).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, np.inf)
    assert len(rows) == 150 * 6
    for r in rows:
        assert abs(np.sort(distance[r["id"]])[r["rank"] - 1] - r["distance"]) < 1e-9


@pytest.mark.parametrize("centered,divisor", [(False, 50), (True, 50), (False, 7), (True, 7), (True, 1), (False, 1)])
def test_rolling_means(spark, centered, divisor):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"run": name, "step": np.arange(n), "value": rng.normal(size=n)})
              for name, n in (("a", 401), ("b", 37), ("c", 1))]
    data = pd.concat(frames)
    got = R.rolling_mean(spark.createDataFrame(data), "value", ["step"], ["run"], divisor, centered).toPandas()
    for name, frame in data.groupby("run"):
        want = frame["value"].rolling(max(1, len(frame) // divisor), min_periods=1, center=centered).mean()
        mine = got[got["run"] == name].sort_values("step")["smoothed"]
        assert np.allclose(mine, want)


def test_rolling_goldens(spark):
    rows = [(i, float(2**i)) for i in range(7)]
    df = spark.createDataFrame(rows, "step int, value double").withColumn("run", F.lit("r"))
    trailing = R.rolling_mean(df, "value", ["step"], ["run"], 2).orderBy("step").collect()
    assert np.allclose([r["smoothed"] for r in trailing],
                       [1, 1.5, 7 / 3, 14 / 3, 28 / 3, 56 / 3, 112 / 3])


def test_sampling_sizes(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"))
    for n in (1, 50, 1500):
        sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
        drawn = {r["s"]: r["count"] for r in S.stratified_random(df, "s", "id", n, 9).groupBy("s").count().collect()}
        assert drawn == {s: min(n, c) for s, c in sizes.items()}
    assert S.stratified_head(df, "s", "id", 0).count() == 3000
    assert S.subsample(df, "id", 700).count() == 700
    assert S.subsample(df, "id", 5000).count() == 3000
    first = sorted(r["id"] for r in S.subsample(df.repartition(1), "id", 700).collect())
    assert first == sorted(r["id"] for r in S.subsample(df.repartition(9), "id", 700).collect())


def test_quantiles_with_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 4), ("b", None)], "g string, v int")
    rows = {r["g"]: r for r in P.length_summary(df, F.col("v"), ["g"]).collect()}
    assert (rows["a"]["count"], rows["a"]["median"], rows["a"]["p5"], rows["a"]["p95"]) == (2, 2.5, 1, 4)
    assert rows["b"]["count"] == 0 and rows["b"]["mean"] is None


def test_config_references(spark):
    config = {"a": {"b": ["s3://x", "hf://y"]}, "c": "z", "d": json.dumps({"e": ["gs://q/file.bin"]})}
    df = spark.createDataFrame([(1, json.dumps(config))], "id int, config string")
    got = {(r["path"], r["label"], r["match"]) for r in G.config_references(df, "id", "config").collect()}
    assert got == {("a.b[0]", "S3 path", "s3://x"), ("a.b[1]", "HF protocol URL", "hf://y"),
                   ("d.e[0]", "GCS path", "gs://q/file.bin"), ("d.e[0]", "Data file extension", ".bin")}


def test_summary_values_keep_numbers_only(spark):
    df = spark.createDataFrame([(1, '{"loss": 1.5, "val": "2.5", "acc": true, "other": 3}')], "id int, s string")
    got = {(r["name"], r["value"]) for r in G.summary_values(df, "id", "s", R.SUMMARY_WORDS).collect()}
    assert got == {("loss", 1.5), ("acc", 1.0)}


def test_length_gate(spark):
    rows = [(1, "s", "", "", ""), (2, "s", "a b c d e f", "", ""), (3, "s", "abc", "", ""), (4, "s", "aa bb", "cc", "dd")]
    df = spark.createDataFrame(rows, "key int, dataset_source string, user_prompt string, think_text string, response_text string")
    kept, dropped = E.length_gate(df, "key", lambda c: F.size(F.split(c, r"\s+")), max_length=5)
    assert sorted(r["key"] for r in kept.collect()) == [3]
    assert {(r["id"], r["reason"], r["token_count"]) for r in dropped.collect()} == {
        (1, "empty", 0), (2, "too_long", 6), (4, "too_long", 4)}


def test_python_tokeniser_sees_long_texts_only(spark):
    rows = [(i, "s", "word " * (3 if i % 2 else 300), "", "") for i in range(10)]
    df = spark.createDataFrame(rows, "key int, dataset_source string, user_prompt string, think_text string, response_text string")

    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        assert (texts.str.len() > 100).all()
        return texts.str.split().str.len()

    kept, dropped = E.length_gate(df, "key", tokens, max_length=60)
    assert kept.count() == 5 and dropped.count() == 5


def test_embed_with_a_model(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id bigint, t string")
    out = D.embed_texts(df, "id", "t", load=lambda: lambda texts: [[float(len(t))] for t in texts], batch_size=2)
    assert {r["id"]: r["embedding"] for r in out.collect()} == {i: [float(i)] for i in range(5)}


def test_misaligned_vectors_are_refused(spark, tmp_path):
    vectors = spark.range(5).withColumn("embedding", F.array(F.lit(1.0)))
    with pytest.raises(ValueError):
        W.write_embeddings(vectors, spark.range(4), str(tmp_path / "v"))


def test_dropped_table_keeps_its_columns_when_empty(spark, tmp_path):
    empty = spark.createDataFrame([], W.DROPPED_SCHEMA)
    W.write_dropped(empty, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).columns == ["id", "dataset_source", "reason", "token_count"]


def test_dense_ids_keep_null_and_repeated_keys(spark):
    from strataline.operators import order as O

    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "k long, v string")
    rows = O.with_dense_id(df, ["k"]).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3] and sorted(r["v"] for r in rows) == list("abcd")
    assert len(O.shuffle_rows(df, "k").collect()) == 4


def test_richest_run_takes_text_ids(spark):
    history = spark.createDataFrame([("b", "m1"), ("b", "m2"), ("a", "m1"), ("a", "m2"), ("c", "m1")], "run_id string, metric string")
    assert tuple(R.richest_run(history).first()) == ("a", 2)


def test_pca_leaves_null_vectors_out_and_refuses_ragged_ones(spark):
    full = [(i, [float(i), float(i * i), 1.0, -float(i)]) for i in range(4)]
    df = spark.createDataFrame(full + [(9 + i, None) for i in range(4)], "id long, v array<double>")
    model = V.pca_fit(df, "v", 2).collect()
    assert {len(r["component"]) for r in model} == {4} and model[0]["n_rows"] == 4
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        V.pca_fit(ragged, "v", 1).count()


def test_knn_takes_text_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert {r["id"]: r["neighbor_id"] for r in V.knn_graph(df, "id", "v", k=1).collect()} == {"a": "b", "b": "a", "c": "b"}


def test_length_gate_measures_wide_characters(spark):
    from strataline.operators import extract as E

    rows = spark.createDataFrame([(1, "s", "漢" * 390, "", ""), (2, "s", "a" * 196, "", "")],
                                 "id long, dataset_source string, user_prompt string, think_text string, response_text string")
    kept, dropped = E.length_gate(rows, "id", lambda t: F.octet_length(t), 198)
    assert [r["id"] for r in dropped.collect()] == [1] and [r["id"] for r in kept.collect()] == [2]


def test_pca_far_from_zero(spark):
    data = np.random.default_rng(5).normal(size=(2000, 4)) * [3, 2, 1, 0.5] + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>").repartition(4)
    rows = V.pca_fit(df, "v", 4).orderBy("pc").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov((data - 1e6).T)))[::-1]
    assert np.allclose([r["explained_variance"] for r in rows], want, rtol=1e-8)
    assert np.allclose(rows[0]["mean"], data.mean(axis=0))
    assert V.pca_fit(df.where("id < 0"), "v", 2).count() == 0


def test_config_roots_of_any_kind(spark):
    rows = [(1, '["s3://arr", {"a": "x"}]'), (2, "s3://top"), (3, '"s3://quoted"'), (4, '{"a": ["y"]}'), (5, None), (6, "7")]
    df = spark.createDataFrame(rows, "id int, config string")
    got = {tuple(r) for r in G.config_leaves(df, "id", "config").collect()}
    assert got == {(1, "[0]", "s3://arr"), (1, "[1].a", "x"), (2, "", "s3://top"), (3, "", "s3://quoted"), (4, "a[0]", "y")}
