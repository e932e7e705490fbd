"""The registered queries of the training-data operators, and the pipeline's stages."""

import pytest
from oracle import compare, connect

import __spark_entry__
import corpus_pipeline
from strataline.llm import queries  # noqa: F401
from strataline.session import materialise

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    if name in __spark_entry__.oracle_sql():
        compare(df, connect(FOLDER), __spark_entry__.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
