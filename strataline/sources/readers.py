"""Readers. All lazy; column pruning and predicate pushdown are the Parquet reader's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PROBE_SCHEMA = ("stage string, repo string, revision string, file_key string, step string, "
                "responses array<string>")
RUN_SCHEMA = ("id string, name string, state string, created_at string, tags array<string>, "
              "config string, summary string")
HISTORY_SCHEMA = "run_id string, step bigint, metric string, value double"


def scan_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


read_parquet = scan_parquet


def from_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset folder, or one split of it when the splits are sub-folders."""
    return spark.read.parquet(f"{path.rstrip('/')}/{split}" if split else path)


def preview_scan(spark: SparkSession, path: str, rows: int, subset: str | None = None) -> DataFrame:
    """The first rows a scan meets; Spark stops reading once it has them."""
    return from_dataset(spark, path, subset).limit(rows)


def schema_of(df: DataFrame) -> DataFrame:
    """(position, name, type) without reading data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position bigint, name string, type string")


def normalise_source(df: DataFrame) -> DataFrame:
    """Both names of the source column become ``source``."""
    return df.withColumnRenamed("dataset_source", "source") if "source" not in df.columns else df


def read_probe_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One JSON file per checkpoint (or, without ``multiline``, one line per result); an older form
    without a key is named after its file."""
    raw = spark.read.schema(PROBE_SCHEMA).json(path, multiLine=multiline)
    from_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.withColumn("file_key", F.coalesce("file_key", from_name)).drop("step")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def read_history(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """Long history; with ``metrics``, only those, pushed down to the scan."""
    history = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    return history.where(F.col("metric").isin(metrics)) if metrics else history


def read_embeddings(spark: SparkSession, path: str, text_type: str | None = None) -> DataFrame:
    vectors = spark.read.parquet(path)
    return vectors.where(F.col("text_type") == text_type) if text_type else vectors


def detect_text_types(vectors: DataFrame) -> DataFrame:
    return vectors.select("text_type").distinct()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Raises when the path is missing, as the read itself does."""
    return spark.read.parquet(path)


def metadata_report(metadata: DataFrame, source: str = "dataset_source") -> DataFrame:
    null_seen = F.coalesce(F.max(F.col(source).isNull().cast("bigint")), F.lit(0))
    return metadata.agg(F.count("*").alias("rows"), (F.count_distinct(source) + null_seen).alias("sources"))


def read_by_source(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """A folder with one ``safe_source=`` sub-folder per source; one source prunes to its folder."""
    df = spark.read.parquet(path)
    return df.where(F.col("safe_source") == source) if source else df
