"""The written pipelines end to end, and the readers that need files."""

import json

import pytest
from pyspark.sql import functions as F

from strataline.operators import probes as B
from strataline.plans import embedding as P
from strataline.plans.lineage import LineageConfig, build_lineage, composition_by_checkpoint, read_lineage
from strataline.sources import readers as R, writers as W


def talks(spark):
    rows = [(i, f"src{i % 3}", [("user", "q" * (i + 1)), ("assistant", f"<think>t{i}</think>{'word ' * (i * 10)}")])
            for i in range(20)] + [(20, "src0", [("user", "no answer")])]
    return spark.createDataFrame(rows, "key bigint, source string, messages array<struct<role:string,content:string>>")


def words(c):
    return F.size(F.split(F.trim(c), r"\s+"))


def test_preparation_and_embedding(spark, tmp_path):
    path = str(tmp_path)
    kept = P.prepare_records(talks(spark), path, "key", words, max_length=100)
    dropped = spark.read.parquet(f"{path}/dropped")
    assert kept.count() + dropped.count() == 20
    assert {r["reason"] for r in dropped.collect()} == {"too_long"}
    assert sorted(r["id"] for r in kept.collect()) == list(range(kept.count()))
    first = kept.where("id < 5")
    P.embed_records(first, f"{path}/vectors")
    vectors = P.embed_records(kept, f"{path}/vectors", finished=spark.read.parquet(f"{path}/vectors"))
    assert vectors.count() == kept.count() == vectors.select("id").distinct().count()
    done = P.finish_embedding(kept, vectors, f"{path}/by_source")
    assert done.count() == kept.count() and {r["safe_source"] for r in done.collect()} == {"src0", "src1", "src2"}
    with pytest.raises(ValueError):
        P.finish_embedding(kept, vectors.where("id > 0"), f"{path}/refused")


def test_sampled_preparation(spark, tmp_path):
    kept = P.prepare_records(talks(spark), str(tmp_path / "a"), "key", words, sample_size=2, seed=1)
    assert {r["dataset_source"]: r["count"] for r in kept.groupBy("dataset_source").count().collect()} == {
        "src0": 2, "src1": 2, "src2": 2}


def test_null_prompt_is_kept(spark):
    from strataline.operators.extract import length_gate

    rows = [(1, "s", None, "a", "b"), (2, "s", "p", "a", "b")]
    df = spark.createDataFrame(rows, "key int, dataset_source string, user_prompt string, think_text string, response_text string")
    kept, dropped = length_gate(df, "key", words, 100)
    assert kept.count() == 2 and dropped.count() == 0


def test_lineage_tables_can_be_queried(spark, tmp_path):
    docs = spark.range(500).select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.col("id") % 50 + 1).alias("n"))
    made = build_lineage(docs, "id", "source", "n", LineageConfig(64, 1000, 4, 2))
    W.write_lineage(made, str(tmp_path / "lineage"))
    steps = spark.read.parquet(str(tmp_path / "lineage" / "training_steps"))
    assert steps.count() == made.stats.first()["total_steps"] * 4
    report = composition_by_checkpoint(made, 10)
    reread = read_lineage(spark, str(tmp_path / "lineage"))
    assert sorted(map(tuple, composition_by_checkpoint(reread, 10).collect())) == sorted(map(tuple, report.collect()))
    W.write_composition_csv(report, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == report.count()
    replayed = build_lineage(docs, "id", "source", "n", LineageConfig(64, 1000, 4, 2, replay=True))
    assert replayed.training_steps.count() == steps.count()


def test_probe_files(spark, tmp_path):
    (tmp_path / "step1.json").write_text(json.dumps({"step": "1", "responses": ["I am Qwen", "<think>x</think>hi"]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"stage": "SFT", "file_key": "k", "responses": []}, indent=1))
    read = R.read_probe_results(spark, str(tmp_path))
    assert sorted(r["file_key"] for r in read.collect()) == ["k", "step1"]
    entries = B.probe_entries(B.explode_responses(read)).orderBy("sample").collect()
    assert [(r["answer"], r["think"], r["identity"]) for r in entries] == [
        ("I am Qwen", "", "Qwen"), ("hi", "x", "Generic AI")]
