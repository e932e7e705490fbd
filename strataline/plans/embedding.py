"""From conversations to embedded, filtered records, each stage a table that a later run can reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import extract as E, models, order, sampling
from ..sources import writers
from ..operators.checks import check_aligned


def prepare_records(conversations: DataFrame, path: str, key: str, token_length: Callable[[Column], Column],
                    source: str = "source", sample_size: int = 0, seed: int | None = None,
                    max_length: int = 32_768) -> DataFrame:
    """Sample, extract, gate by length, number.

    Writes ``extracted``, ``dropped`` and ``kept``. The wide text is extracted once. The long texts, a
    few percent of the rows, are written with their token counts, so the tokeniser runs once on each.
    """
    spark = conversations.sparkSession
    if seed is None:
        sampled = sampling.stratified_head(conversations, source, key, sample_size)
    else:
        sampled = sampling.stratified_random(conversations, source, key, sample_size, seed)
    writers.write_extracted(E.extract_combined(sampled, key, source, dense_ids=False), f"{path}/extracted")
    extracted = spark.read.parquet(f"{path}/extracted")
    safe, measured = E.measure_tokens(extracted, token_length, max_length)
    measured.write.mode("overwrite").parquet(f"{path}/measured")
    measured = spark.read.schema(measured.schema).parquet(f"{path}/measured")
    kept, dropped = E.split_measured(safe.unionByName(measured), key, max_length)
    writers.write_dropped(dropped, f"{path}/dropped")
    order.with_dense_id(kept, [key]).write.mode("overwrite").parquet(f"{path}/kept")
    return spark.read.parquet(f"{path}/kept")


def embed_records(records: DataFrame, path: str, load=None, finished: DataFrame | None = None,
                  batch_size: int = 64) -> DataFrame:
    """Vectors of the records' joined text; records in ``finished`` are skipped, the rest appended."""
    from ..functions.text import concat_record_text, placeholder_empty

    todo = E.resume_skip(records, finished, "id") if finished is not None else records
    text = concat_record_text(F.col("user_prompt"), F.col("think_text"), F.col("response_text"))
    texts = todo.select("id", placeholder_empty(text).alias("text"))
    vectors = models.embed_texts(texts, "id", "text", load, batch_size)
    vectors.write.mode("append").parquet(path)
    return records.sparkSession.read.parquet(path)


def finish_embedding(records: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """Check that every record has its vector, then write both by source."""
    finding = check_aligned(vectors, records).first()
    if not finding["ok"]:
        raise ValueError(f"vectors and records differ: {finding.asDict()}")
    writers.write_by_source(models.attach_vectors(records, vectors), path)
    return records.sparkSession.read.parquet(path)
