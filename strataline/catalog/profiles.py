"""Dataset profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M, text as X
from ..operators import checks as K, profile as P
from .registry import query
from .tables import CHAT, CONV_ID, chat, conversation_id, plain_messages, sft, table


def _distribution(source: str, key: str, extra: str = "") -> str:
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS "count", 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total, CAST(count(*) OVER () AS BIGINT) AS groups{extra} FROM {source} GROUP BY {key}"""


@query("distribution", _distribution(
    "documents", "source", ", repeat('█', CAST(floor(100.0::DOUBLE * count(*) / sum(count(*)) OVER () / 2) AS INTEGER)) AS bar"))
def distribution(spark, d):
    return P.distribution(table(spark, d, "documents"), "source", bar=True)


@query("distribution_by_parsed_name", f"""
WITH ids AS (SELECT DISTINCT conv_id, {CONV_ID} AS id FROM conversations),
n AS (SELECT regexp_replace(regexp_replace(regexp_replace(id, '_[a-f0-9]{{8}}-[a-f0-9-]+.*$', ''),
  '_[a-z0-9]{{7}}$', ''), '_[0-9]+$', '') AS dataset_name FROM ids) {_distribution("n", "dataset_name")}""")
def distribution_by_parsed_name(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    return P.distribution(ids.withColumn("dataset_name", X.dataset_name_from_id(conversation_id())), "dataset_name")


def _summary(value: str, source: str, by: str = "") -> str:
    """Quantiles from sorted lists, where the operator uses a histogram."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}CAST(len(l) AS BIGINT) AS "count", s / len(l) AS mean, m AS median,
  CAST(l[CAST(1 + round((len(l) - 1) * 0.05::DOUBLE) AS BIGINT)] AS BIGINT) AS p5,
  CAST(l[CAST(1 + round((len(l) - 1) * 0.95::DOUBLE) AS BIGINT)] AS BIGINT) AS p95,
  CAST(l[1] AS BIGINT) AS "min", CAST(l[-1] AS BIGINT) AS "max"
FROM (SELECT {lead}list_sort(list({value})) AS l, CAST(sum({value}) AS DOUBLE) AS s, CAST(median({value}) AS DOUBLE) AS m FROM {source}{group})"""


@query("length_summary", f"WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) {_summary('n', 't')}")
def length_summary(spark, d):
    return P.turn_summary(sft(spark, d))


@query("length_summary_by_role", f"WITH {CHAT} {_summary('length(content)', 'chat', 'role')}")
def length_summary_by_role(spark, d):
    return P.length_summary_by_role(chat(spark, d))


@query("quantile", """
SELECT lang, CAST(quantile_disc(n_chars, 0.25) AS DOUBLE) AS disc, quantile_cont(n_chars, 0.25) AS cont,
  list_sort(list(n_chars))[CAST(1 + round((count(*) - 1) * 0.25::DOUBLE) AS BIGINT)] AS nearest FROM documents GROUP BY lang""")
def quantile(spark, d):
    docs = table(spark, d, "documents")
    parts = [P.quantile(docs, F.col("n_chars"), 0.25, ["lang"], m).withColumnRenamed("quantile", m)
             for m in ("disc", "cont", "nearest")]
    return parts[0].join(parts[1], "lang").join(parts[2], "lang")


@query("think_rate", f"""WITH {CHAT}, a AS (SELECT contains(content, '<think>') AND contains(content, '</think>') AS t FROM chat WHERE role = 'assistant')
SELECT CAST(count(*) AS BIGINT) AS total_asst, CAST(count(*) FILTER (t) AS BIGINT) AS think_count,
  100.0::DOUBLE * count(*) FILTER (t) / greatest(count(*), 1) AS pct FROM a""")
def think_rate(spark, d):
    return P.think_rate(chat(spark, d))


@query("think_length_summary", f"""WITH {CHAT},
t AS (SELECT content AS c FROM chat WHERE role = 'assistant' AND contains(content, '<think>') AND contains(content, '</think>')),
parts AS (SELECT 'think' AS part, length(str_split(c, '</think>')[1]) + 8 AS n FROM t
  UNION ALL SELECT 'response', length(regexp_replace(str_split(c, '</think>')[2], '^[[:space:]]+|[[:space:]]+$', '', 'g')) FROM t),
r AS ({_summary("n", "parts", "part")})
SELECT part, "count", mean, median, p5, p95 FROM r""")
def think_length_summary(spark, d):
    return P.think_length_summary(chat(spark, d))


@query("matched_rows_by_source", f"""WITH {CHAT}
SELECT source, CAST(count(*) AS BIGINT) AS "count" FROM chat WHERE regexp_matches(content, '(?i)than') GROUP BY source""")
def matched_rows_by_source(spark, d):
    return P.matched_rows_by_source(chat(spark, d), "than")


@query("semi_join_convs", f"""WITH {CHAT}
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns FROM chat
WHERE conv_id IN (SELECT conv_id FROM chat WHERE regexp_matches(content, '(?i)than')) GROUP BY conv_id""")
def semi_join_convs(spark, d):
    matched = P.mentioning(chat(spark, d), "than")
    return P.semi_join_convs(sft(spark, d), matched, "conv_id").select(
        "conv_id", M.turn_count(F.col("messages")).alias("turns"))


@query("system_prompt_stats", """
SELECT CAST(count(DISTINCT conv_id) AS BIGINT) AS conversations,
  CAST(count(DISTINCT conv_id) FILTER (role = 'system') AS BIGINT) AS with_system,
  CAST(count(DISTINCT text) FILTER (role = 'system') AS BIGINT) AS unique_prompts,
  100.0::DOUBLE * count(DISTINCT conv_id) FILTER (role = 'system') / greatest(count(DISTINCT conv_id), 1) AS pct FROM conversations""")
def system_prompt_stats(spark, d):
    return P.system_prompt_stats(plain_messages(spark, d), "conv_id")


@query("system_prompts_by_source", f"""WITH {CHAT}
SELECT source, CAST(count(DISTINCT conv_id) AS BIGINT) AS convs FROM chat WHERE role = 'system' GROUP BY source""")
def system_prompts_by_source(spark, d):
    return P.system_prompts_by_source(plain_messages(spark, d), "conv_id")


@query("top_values", """
SELECT text, CAST(count(*) AS BIGINT) AS "count",
  replace(substr(text, 1, 120), chr(10), ' ') || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS preview
FROM documents GROUP BY text ORDER BY count(*) DESC, text LIMIT 15""")
def top_values(spark, d):
    return P.top_values(table(spark, d, "documents"), "text")


@query("top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def top_k(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("n_unique", """
SELECT lang, CAST(count(DISTINCT nullif(source, 'src3')) + max(CASE WHEN source = 'src3' THEN 1 ELSE 0 END) AS BIGINT) AS n_unique
FROM documents GROUP BY lang""")
def n_unique(spark, d):
    docs = table(spark, d, "documents").withColumn("source", F.nullif(F.col("source"), F.lit("src3")))
    return P.n_unique(docs, "source", ["lang"])


@query("distinct_sources", "SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sources(spark, d):
    return P.distinct_sources(table(spark, d, "documents"), "source")


@query("filter_eq", f"""WITH s AS (SELECT DISTINCT conv_id, {CONV_ID} AS id FROM conversations)
SELECT conv_id FROM s WHERE starts_with(id, 'hard_coded_')""")
def filter_eq(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    return ids.where(X.dataset_name_from_id(conversation_id()) == "hard_coded")


@query("filter_null_or_empty", """
SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')""")
def filter_null_or_empty(spark, d):
    blank = F.when(F.col("source") == "src1", F.lit("")).when(F.col("source") != "src2", F.col("source"))
    return P.filter_null_or_empty(table(spark, d, "documents").withColumn("source", blank), "source").select("doc_id")


@query("filter_sources", """
SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'c7')""")
def filter_sources(spark, d):
    return P.filter_sources(table(spark, d, "documents"), "source", ["SRC1", "C7"]).select("doc_id", "source")


@query("filter_sources_counts", """
SELECT source, CAST(count(*) AS BIGINT) AS "count" FROM documents WHERE contains(lower(source), 'src1') GROUP BY source""")
def filter_sources_counts(spark, d):
    kept = P.filter_sources(table(spark, d, "documents"), "source", ["Src1"])
    return kept.groupBy("source").agg(F.count("*").alias("count"))


@query("token_stats", """
SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS total_tokens,
  CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_tokens, max(n_chars) AS max_tokens, min(n_chars) AS min_tokens FROM documents""")
def token_stats(spark, d):
    return P.token_stats(table(spark, d, "documents"), "n_chars")


@query("check_row_count", "SELECT CAST(1500 AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS actual, abs(count(*) - 1500) < 1000 AS ok FROM documents")
def check_row_count(spark, d):
    return K.check_row_count(table(spark, d, "documents"), 1500)


@query("check_expected_total", "SELECT CAST(1500 AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS actual, CAST(1500 - count(*) AS BIGINT) AS difference FROM documents")
def check_expected_total(spark, d):
    return K.check_expected_total(table(spark, d, "documents"), 1500)


@query("check_source_counts", """
WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
e AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT coalesce(a.source, e.source) AS source, CAST(coalesce(a.n, 0) AS BIGINT) AS actual,
  CAST(coalesce(e.n, 0) AS BIGINT) AS expected, CAST(coalesce(e.n, 0) - coalesce(a.n, 0) AS BIGINT) AS difference
FROM a FULL JOIN e ON a.source = e.source""")
def check_source_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    good = table(spark, d, "labels").where(F.col("quality") == 1)
    expected = docs.join(good, "doc_id").groupBy("source").agg(F.count("*").alias("expected"))
    return K.check_source_counts(docs, "source", expected)


@query("check_aligned", """
SELECT CAST((SELECT count(*) FROM labels) AS BIGINT) AS vectors, CAST((SELECT count(*) FROM documents) AS BIGINT) AS metadata,
  CAST((SELECT count(*) FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL) AS BIGINT) AS unmatched,
  (SELECT count(*) FROM labels) = (SELECT count(*) FROM documents)
    AND (SELECT count(*) FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS ok""")
def check_aligned(spark, d):
    return K.check_aligned(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")
