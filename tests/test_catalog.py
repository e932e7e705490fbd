"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from strataline.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


OWN = sorted(n for n, fn in QUERIES.items() if fn.__module__.startswith("strataline.catalog"))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        compare(df, db, ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


# Operators whose result must not depend on how the input is split into files and partitions.
ORDERED = [
    "assign_chunks", "batch_groups", "checkpoint_composition", "contiguous_shards", "dense_id", "distribution",
    "epoch_order", "examples_per_source", "extract_combined", "filter_by_length", "identity_counts", "knn_graph",
    "last_assistant", "length_summary_by_role", "pack_documents", "pca_by_source", "pc_extremes_by_coordinate",
    "prefix_select", "prefix_sum_by_source", "richest_run", "rolling_mean_centered", "rolling_mean_trailing",
    "shuffle_rows", "stage_spans", "stratified_head", "stratified_random", "subsample", "systematic_sample",
    "think_length_summary", "top_values", "training_schedule",
]


@pytest.fixture(scope="module")
def split_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("split")
    for name in ("documents", "conversations", "events", "embeddings", "labels"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        df.repartition(7, df.columns[1]).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ORDERED)
def test_partition_invariance(spark, db, split_folder, name):
    compare(QUERIES[name](spark, split_folder), db, ORACLES[name])
