"""Readers and writers, each on the shared tables or on files written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators.probes import explode_responses
from ..plans.lineage import read_lineage
from ..session import scratch_path
from ..sources import readers as R, writers as W
from . import lineage as L
from .conversations import GATED, _gate
from .registry import query
from .tables import CHAT, EXTRACT, HISTORY, RUNS, VECTORS, events_history, run_table, sft, table, vectors


@query("scan_parquet", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def scan_parquet(spark, d):
    return R.scan_parquet(spark, f"{d}/documents*.parquet").where(F.col("n_chars") > 1000).select("doc_id", "lang")


@query("read_parquet", "SELECT doc_id, quality, toxic FROM labels")
def read_parquet(spark, d):
    return R.read_parquet(spark, f"{d}/labels.parquet").select("doc_id", "quality", "toxic")


@query("from_dataset", "SELECT item_id, text FROM benchmark")
def from_dataset(spark, d):
    return R.from_dataset(spark, d, "benchmark.parquet").select("item_id", "text")


@query("preview_scan", "SELECT CAST(count(*) AS BIGINT) AS rows FROM (SELECT * FROM documents LIMIT 5)")
def preview_scan(spark, d):
    return R.preview_scan(spark, d, 5, "documents.parquet").agg(F.count("*").alias("rows"))


@query("schema_of", """
SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS position, column_name AS name,
  replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int') AS type FROM (DESCRIBE documents)""")
def schema_of(spark, d):
    return R.schema_of(table(spark, d, "documents"))


@query("read_probe_results", f"WITH {CHAT} SELECT 'conv' || conv_id AS file_key, CAST(count(*) AS BIGINT) AS responses, CAST(sum(length(content)) AS BIGINT) AS chars FROM chat GROUP BY conv_id")
def read_probe_results(spark, d):
    path = scratch_path(spark, "probes")
    results = sft(spark, d).select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("file_key"),
                                   F.col("messages.content").alias("responses"))
    results.write.json(path)
    read = explode_responses(R.read_probe_results(spark, path, multiline=False))
    return read.groupBy("file_key").agg(F.count("*").alias("responses"), F.sum(F.length("raw")).alias("chars"))


@query("read_runs", f"WITH {RUNS} SELECT CAST(id AS VARCHAR) AS id, name, state, tags, config FROM runs")
def read_runs(spark, d):
    path = scratch_path(spark, "runs")
    run_table(spark, d).withColumn("id", F.col("id").cast("string")).write.json(path)
    return R.read_runs(spark, path).select("id", "name", "state", F.array_join("tags", ", ").alias("tags"), "config")


@query("read_history", f"WITH {HISTORY} SELECT CAST(run_id AS VARCHAR) AS run_id, step, metric, value FROM history WHERE metric IN ('train/CE loss', 'throughput')")
def read_history(spark, d):
    path = scratch_path(spark, "history")
    events_history(spark, d).withColumn("run_id", F.col("run_id").cast("string")).write.parquet(path)
    return R.read_history(spark, path, ["train/CE loss", "throughput"]).select("run_id", "step", "metric", "value")


def _typed_vectors(spark, d):
    path = scratch_path(spark, "vectors")
    typed = vectors(spark, d).withColumn("text_type", F.when(F.col("id") % 2 == 0, "think").otherwise("response"))
    typed.write.partitionBy("text_type").parquet(path)
    return path


@query("read_embeddings", f"WITH {VECTORS} SELECT id, source, CAST(len(embedding) AS BIGINT) AS width FROM vectors WHERE id % 2 = 0")
def read_embeddings(spark, d):
    return R.read_embeddings(spark, _typed_vectors(spark, d), "think").select(
        "id", "source", F.size("embedding").cast("bigint").alias("width"))


@query("detect_text_types", f"WITH {VECTORS} SELECT DISTINCT CASE WHEN id % 2 = 0 THEN 'think' ELSE 'response' END AS text_type FROM vectors")
def detect_text_types(spark, d):
    return R.detect_text_types(R.read_embeddings(spark, _typed_vectors(spark, d)))


@query("read_metadata", f"WITH {EXTRACT} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM split")
def read_metadata(spark, d):
    path = scratch_path(spark, "metadata")
    W.write_extracted(E.extract_combined(sft(spark, d), "conv_id", dense_ids=False), path)
    return R.metadata_report(R.read_metadata(spark, path))


@query("write_extracted", f"WITH {EXTRACT} SELECT conv_id, source AS dataset_source, think_text, response_text, num_turns FROM split")
def write_extracted(spark, d):
    path = scratch_path(spark, "extracted")
    W.write_extracted(E.extract_combined(sft(spark, d), "conv_id", dense_ids=False), path)
    return spark.read.parquet(path).select("conv_id", "dataset_source", "think_text", "response_text", "num_turns")


@query("write_dropped", f"""WITH {GATED}
SELECT conv_id AS id, source AS dataset_source, 'too_long' AS reason, tokens AS token_count FROM counted WHERE length(t) > 0 AND tokens > 198""")
def write_dropped(spark, d):
    path = scratch_path(spark, "dropped")
    W.write_dropped(_gate(spark, d)[1], path)
    return spark.read.schema(W.DROPPED_SCHEMA).parquet(path).where(F.col("reason") == "too_long")


@query("write_by_source", f"WITH {VECTORS} SELECT 'team/' || source || ' a' AS dataset_source, id, 'team_' || source || '_a' AS safe_source FROM vectors")
def write_by_source(spark, d):
    path = scratch_path(spark, "by-source")
    named = vectors(spark, d).withColumn("dataset_source", F.concat(F.lit("team/"), "source", F.lit(" a")))
    W.write_by_source(named, path)
    return R.read_by_source(spark, path).select("dataset_source", "id", "safe_source")


@query("read_by_source", f"WITH {VECTORS} SELECT id, source AS dataset_source FROM vectors WHERE source = 'src3'")
def read_by_source(spark, d):
    path = scratch_path(spark, "by-source")
    W.write_by_source(vectors(spark, d).withColumnRenamed("source", "dataset_source"), path)
    return R.read_by_source(spark, path, "src3").select("id", "dataset_source")


@query("write_embeddings", f"WITH {VECTORS} SELECT id, round(CAST(embedding[2] AS DOUBLE), 6) AS second FROM vectors")
def write_embeddings(spark, d):
    path = scratch_path(spark, "embeddings")
    rows = vectors(spark, d)
    W.write_embeddings(rows.select("id", "embedding"), rows.select("id", "source"), path)
    return R.read_embeddings(spark, path).select("id", F.round(F.col("embedding")[1].cast("double"), 6).alias("second"))


@query("write_extremes", f"""WITH {VECTORS}
SELECT id, CAST(row_number() OVER (ORDER BY embedding[1] DESC, id) AS BIGINT) AS rank FROM vectors QUALIFY rank <= 5""")
def write_extremes(spark, d):
    from ..operators.vectors import pc_extremes

    path = scratch_path(spark, "extremes")
    rows = vectors(spark, d)
    scores = rows.select("id", F.lit("all").alias("grp"), F.lit(1).alias("pc"), F.col("embedding")[0].cast("double").alias("score"))
    W.write_extremes(pc_extremes(scores, rows.select("id", "source"), "id", 5), path)
    return spark.read.parquet(path).where(F.col("direction") == "positive").select("id", F.col("rank").cast("bigint").alias("rank"))


@query("write_run_config", """
SELECT 'sample_size' AS setting, CAST(count(*) AS VARCHAR) AS wanted, CAST(count(*) + 1 AS VARCHAR) AS saved FROM documents""")
def write_run_config(spark, d):
    path = scratch_path(spark, "run-config")
    config = table(spark, d, "documents").agg((F.count("*") + 1).alias("sample_size"), F.lit("x").alias("model"))
    W.write_run_config(config, path)
    wanted = table(spark, d, "documents").agg(F.count("*").alias("sample_size"), F.lit("x").alias("model"))
    return E.check_resume_config(wanted, spark.read.json(path))


@query("write_lineage", L.FULL + "SELECT step, source_dataset, CAST(count(*) AS BIGINT) AS docs, CAST(sum(token_count) AS BIGINT) AS tokens FROM seen GROUP BY step, source_dataset")
def write_lineage(spark, d):
    path = scratch_path(spark, "lineage")
    W.write_lineage(L.lineage(spark, d), path)
    joined = read_lineage(spark, path).joined()
    return joined.groupBy("step", "source_dataset").agg(F.count("*").alias("docs"), F.sum("token_count").alias("tokens"))


@query("write_composition_csv", L.FULL + f"""SELECT CAST(step // {L.STEP_INTERVAL} * {L.STEP_INTERVAL} AS BIGINT) AS step_start, source_dataset,
  CAST(sum(token_count) AS BIGINT) AS total_tokens FROM seen GROUP BY 1, 2""")
def write_composition_csv(spark, d):
    path = scratch_path(spark, "composition")
    W.write_composition_csv(L.checkpoint_composition(spark, d), path)
    schema = "step_start bigint, step_end bigint, source_dataset string, num_documents bigint, total_tokens bigint"
    return spark.read.schema(schema).csv(path, header=True).select("step_start", "source_dataset", "total_tokens")
