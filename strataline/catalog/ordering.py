"""Order, sampling and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M, text as X
from ..operators import order as O, runs as R, sampling as S
from .registry import query
from .tables import CHAT, HISTORY, REGISTRY, events_history, hash_key, registry, sft, table


@query("dense_id", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS id FROM documents")
def dense_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return O.with_dense_id(docs, ["n_chars", "doc_id"]).select("doc_id", "id")


@query("prefix_sum", """
SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position,
  CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS end_offset FROM documents""")
def prefix_sum(spark, d):
    return O.prefix_sum(table(spark, d, "documents"), ["doc_id"], "n_chars")


@query("prefix_sum_by_source", """
SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS position,
  CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS end_offset FROM documents""")
def prefix_sum_by_source(spark, d):
    return O.prefix_sum(table(spark, d, "documents"), ["doc_id"], "n_chars", within=["source"])


@query("shuffle_rows", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {hash_key("'42'", "doc_id")}, doc_id) - 1 AS BIGINT) AS position FROM documents""")
def shuffle_rows(spark, d):
    return O.shuffle_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@query("contiguous_shards", """
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents)
SELECT doc_id, id, CAST(id // CAST(ceil(n / 7.0) AS BIGINT) AS BIGINT) AS shard FROM r, n""")
def contiguous_shards(spark, d):
    ids = O.with_dense_id(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return O.contiguous_shards(ids, "id", 7).select("doc_id", "id", "shard")


@query("interleave_shards", "SELECT doc_id, doc_id AS row FROM documents")
def interleave_shards(spark, d):
    strided = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"),
                                                  O.int_div(F.col("doc_id"), 4).alias("i"))
    return O.interleave_shards(strided, "shard", "i", 4).select("doc_id", "row")


@query("batch_groups", f"""WITH {REGISTRY}
SELECT ord, file_key, CAST((row_number() OVER (ORDER BY ord) - 1) // 8 + 1 AS BIGINT) AS batch FROM registry""")
def batch_groups(spark, d):
    return O.batch_groups(registry(spark, d), ["ord"]).select("ord", "file_key", "batch")


HEAD = "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) AS r FROM documents) WHERE r <= {n}"


@query("stratified_head", HEAD.format(order="doc_id", n=7))
def stratified_head(spark, d):
    return S.stratified_head(table(spark, d, "documents"), "source", "doc_id", 7).select("doc_id", "source")


@query("stratified_random", HEAD.format(order=hash_key("'7'", "doc_id") + ", doc_id", n=9))
def stratified_random(spark, d):
    return S.stratified_random(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 9, 7)


@query("examples_per_source", f"""WITH {CHAT},
c AS (SELECT conv_id, source, coalesce(arg_min(content, turn) FILTER (role = 'user'), '') AS u,
  coalesce(arg_min(content, turn) FILTER (role = 'assistant'), '') AS a FROM chat GROUP BY conv_id, source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY conv_id) AS rank FROM c)
SELECT conv_id, source, CAST(rank AS BIGINT) AS rank, u AS user_msg,
  CASE WHEN contains(a, '<think>') AND contains(a, '</think>') THEN str_split(a, '</think>')[1] || '</think>' END AS think_block,
  CASE WHEN contains(a, '<think>') AND contains(a, '</think>')
    THEN regexp_replace(array_to_string(str_split(a, '</think>')[2:], '</think>'), '^[[:space:]]+|[[:space:]]+$', '', 'g') ELSE a END AS response
FROM r WHERE rank <= 5""")
def examples_per_source(spark, d):
    kept = S.top_per_group(sft(spark, d), ["source"], [F.col("conv_id")], 5)
    m = F.col("messages")
    split = kept.withColumn("s", X.split_think_block(M.first_message(m, "assistant")))
    return split.select("conv_id", "source", F.col("rank").cast("bigint").alias("rank"),
                        M.first_message(m, "user").alias("user_msg"), "s.think_block", "s.response")


@query("subsample", f"SELECT doc_id FROM documents ORDER BY {hash_key(chr(39) + '42' + chr(39), 'doc_id')}, doc_id LIMIT 100")
def subsample(spark, d):
    return S.subsample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


@query("systematic_sample", f"""WITH {HISTORY},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM history)
SELECT run_id, step, metric, value FROM r WHERE i % CAST(ceil(n / 10.0) AS BIGINT) = 0""")
def systematic_sample(spark, d):
    return S.systematic_sample(events_history(spark, d), ["run_id"], ["step"], 10)


def _rolling(partition: str, order: str, divisor: int, back: str, ahead: str) -> str:
    """Sums each frame on its own by a range join on positions."""
    return f"""WITH {HISTORY},
r AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS i,
        greatest(count(*) OVER (PARTITION BY {partition}) // {divisor}, 1) AS w FROM history)
SELECT a.metric, a.run_id, a.step, a.value, round(avg(b.value), 9) AS smoothed
FROM r a JOIN r b ON {" AND ".join(f"a.{c} = b.{c}" for c in partition.split(", "))}
  AND b.i BETWEEN a.i - ({back}) AND a.i + ({ahead})
GROUP BY a.metric, a.run_id, a.step, a.value"""


@query("rolling_mean_trailing", _rolling("metric, run_id", "step", 4, "a.w - 1", "0"))
def rolling_mean_trailing(spark, d):
    out = R.rolling_mean(events_history(spark, d), "value", ["step"], ["metric", "run_id"], divisor=4)
    return out.withColumn("smoothed", F.round("smoothed", 9))


@query("rolling_mean_centered", _rolling("metric", "step, run_id", 50, "a.w - 1 - (a.w - 1) // 2", "(a.w - 1) // 2"))
def rolling_mean_centered(spark, d):
    out = R.rolling_mean(events_history(spark, d), "value", ["step", "run_id"], ["metric"], divisor=50, centered=True)
    return out.withColumn("smoothed", F.round("smoothed", 9))
