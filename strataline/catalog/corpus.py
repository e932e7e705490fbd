"""Preparing a dataset: mixtures, repeated prompts, verified answers, statistics, and verdicts on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixing as X, statistics as S, textfilters as T
from .registry import query
from .tables import CHAT, chat, hash_key, rounded, sql_rounded, table

WEIGHTS = {"src0": 2.5, "src1": 0.3, "src2": 1, "src3": 0.75, "src4": 0.05, "src5": 1.25, "src6": 0}


@query("mix_datasets", f"""
WITH w(source, w) AS (VALUES {", ".join(f"('{s}', CAST({w} AS DECIMAL(18,6)))" for s, w in WEIGHTS.items())}),
c AS (SELECT source, count(*) AS n, w * count(*) AS claim, floor(w * count(*)) AS base FROM documents JOIN w USING (source) GROUP BY source, w),
t AS (SELECT floor(sum(claim) + 0.5) - sum(base) AS spare FROM c),
q AS (SELECT source, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY claim - base DESC, source) <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM c, t),
d AS (SELECT doc_id, source, length(text) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY {hash_key("'42'", "doc_id")}, doc_id) AS r FROM documents)
SELECT doc_id, source, n_chars, unnest(generate_series(0, quota // n + CASE WHEN r <= quota % n THEN 1 ELSE 0 END - 1)) AS copy
FROM d JOIN q USING (source)""")
def mix_datasets(spark, d):
    mixed = X.mix_datasets(table(spark, d, "documents"), "source", "doc_id", WEIGHTS)
    return mixed.select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"), "copy")


FACTORS = {"set0": 2.5, "set1": 0.4, "set2": 3.7}


@query("upsample", f"""
WITH p AS (SELECT DISTINCT conv_id, 'set' || conv_id % 4 AS dataset FROM conversations),
i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {hash_key("'42'", "conv_id")}, conv_id) - 1 AS i,
  CAST(CASE dataset WHEN 'set0' THEN 2.5 WHEN 'set1' THEN 0.4 WHEN 'set2' THEN 3.7 ELSE 1 END AS DECIMAL(18,6)) AS f FROM p),
r AS (SELECT dataset, conv_id, unnest(generate_series(0, CAST(floor((i + 1) * f) - floor(i * f) AS BIGINT) - 1)) AS repeat FROM i),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE role = 'assistant')
SELECT dataset, r.conv_id, repeat, turn FROM r LEFT JOIN c ON r.conv_id = c.conv_id AND repeat % n = k""")
def upsample(spark, d):
    turns = table(spark, d, "conversations")
    prompts = turns.select("conv_id").distinct().select("conv_id", F.concat(F.lit("set"), (F.col("conv_id") % 4).cast("string")).alias("dataset"))
    answers = turns.where(F.col("role") == "assistant").select("conv_id", "turn")
    return X.upsample(prompts, answers, "conv_id", "dataset", "turn", FACTORS)


@query("verified_only", """
WITH a AS (SELECT doc_id, source, length(text) AS n_chars, quality = 1 AND toxic = 0 AS passed FROM documents JOIN labels USING (doc_id)),
r AS (SELECT source, count(*) AS n_answers, CAST(count(*) FILTER (passed) AS BIGINT) AS n_passed FROM a GROUP BY source),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM a WHERE passed)
SELECT source, doc_id, n_chars, rank, n_answers, n_passed, n_passed / n_answers AS pass_rate FROM b JOIN r USING (source) WHERE rank <= 3""")
def verified_only(spark, d):
    answers = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "source", F.length("text").cast("bigint").alias("n_chars"), "quality", "toxic")
    best = X.verified_only(answers, "source", "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), [F.desc("n_chars")], 3)
    return best.select("source", "doc_id", "n_chars", F.col("rank").cast("bigint").alias("rank"), "n_answers", "n_passed", "pass_rate")


@query("dataset_statistics", """
WITH t AS (SELECT source, lang, CAST(length(text) AS BIGINT) AS n FROM documents),
g AS (SELECT 'source' AS dimension, source AS value, n FROM t UNION ALL SELECT 'lang', lang, n FROM t UNION ALL SELECT 'total', NULL, n FROM t)
SELECT dimension, value, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, max(n) AS greatest, avg(n) AS mean
FROM g GROUP BY dimension, value""")
def dataset_statistics(spark, d):
    """Statistics of the two halves of the documents, merged."""
    docs = table(spark, d, "documents")
    halves = [S.dataset_statistics(docs.where(F.pmod("doc_id", F.lit(2)) == i), ["source", "lang"], F.length("text"), F.col("text")) for i in (0, 1)]
    return S.read_statistics(S.merge_statistics(*halves)).select("dimension", "value", "n_rows", "total", "least", "greatest", "mean")


REASONED = CHAT + """,
reasoned AS (SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN substr(content, 1, length(content) * 2 // 3)
  WHEN 1 THEN '<think>' || content WHEN 2 THEN replace(content, '</think>', '') WHEN 3 THEN content || '</think>'
  WHEN 4 THEN content || '<think>x</think>' ELSE content END AS text FROM chat)"""


def reasoned(spark, d):
    c = F.col("content")
    kind = (F.col("conv_id") + F.col("turn")) % 7
    text = (F.when(kind == 0, F.substring(c, F.lit(1), F.floor(F.length(c) * 2 / 3).cast("int"))).when(kind == 1, F.concat(F.lit("<think>"), c))
            .when(kind == 2, F.replace(c, F.lit("</think>"), F.lit(""))).when(kind == 3, F.concat(c, F.lit("</think>")))
            .when(kind == 4, F.concat(c, F.lit("<think>x</think>"))).otherwise(c))
    return chat(spark, d).select("conv_id", "turn", text.alias("text"))


@query("incomplete_reasoning_filter", f"""WITH {REASONED},
s AS (SELECT *, array_to_string(list_transform(regexp_extract_all(text, '</?think>'), lambda x: CASE x WHEN '<think>' THEN 'o' ELSE 'c' END), '') AS walk,
  regexp_extract(text, '(?s)^(?:.*</?think>)?(.*)$', 1) AS rest FROM reasoned),
v AS (SELECT *, CASE WHEN regexp_matches(walk, '^c|cc') THEN 'unopened' WHEN walk LIKE '%oo%' THEN 'nested' WHEN walk LIKE '%o' THEN 'unclosed'
  WHEN walk = '' THEN 'none' WHEN regexp_full_match(rest, '\\s*') THEN 'unanswered'
  WHEN NOT regexp_matches(rest, '[.!?)\\]"''`}}]\\s*$') THEN 'cut_off' ELSE 'complete' END AS state FROM s)
SELECT conv_id, turn, state, CAST((length(walk) - length(replace(walk, 'oc', ''))) // 2 AS BIGINT) AS blocks, CAST(length(rest) AS BIGINT) AS tail,
  state IN ('none', 'complete') AS kept FROM v""")
def incomplete_reasoning_filter(spark, d):
    """Messages whose reasoning is cut, opened twice, never opened or closed, in several ways by conversation and turn."""
    return T.incomplete_reasoning_filter(reasoned(spark, d), "text").drop("text")


@query("repetition_filter", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram, generate_subscripts(range(1, len(w) - 6), 1) AS i FROM w),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(0, 8) t(k) GROUP BY doc_id),
v AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS repeated_words,
  list_filter(range(1, len(w) // 2 + 1), lambda p: w[1] = w[p + 1] AND w[1:len(w) - p] = w[p + 1:])[1] AS period FROM w LEFT JOIN r USING (doc_id))
SELECT *, period IS NULL AND 100 * repeated_words <= 20 * n_words AS kept FROM v""")
def repetition_filter(spark, d):
    return T.repetition_filter(table(spark, d, "documents"), "doc_id", "text").drop("longest_repeat")


def _lookalikes(column: str, translate):
    """Some documents with Greek or Cyrillic letters that look like Latin ones."""
    return translate(column, "oa", "оа"), translate(column, "abe", "αβε")


@query("char_class_filter", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN translate(text, 'oa', 'оа') WHEN 1 THEN translate(text, 'abe', 'αβε') ELSE text END AS text FROM documents),
c AS (SELECT *, CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(text, '\p{Latin}')) AS BIGINT) AS n_latin,
  CAST(len(regexp_extract_all(text, '\p{Greek}')) AS BIGINT) AS n_greek, CAST(len(regexp_extract_all(text, '\p{Cyrillic}')) AS BIGINT) AS n_cyrillic FROM t)
SELECT doc_id, n_letters, n_latin, n_greek, n_cyrillic,
  CASE WHEN greatest(n_latin, n_greek, n_cyrillic) = 0 THEN NULL WHEN n_latin >= greatest(n_greek, n_cyrillic) THEN 'Latin'
       WHEN n_greek >= n_cyrillic THEN 'Greek' ELSE 'Cyrillic' END AS dominant,
  CASE WHEN n_letters > 0 THEN greatest(n_latin, n_greek, n_cyrillic) / n_letters END AS dominant_share,
  CAST(len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: CAST(regexp_matches(w, '\p{Latin}') AS INT)
    + CAST(regexp_matches(w, '\p{Greek}') AS INT) + CAST(regexp_matches(w, '\p{Cyrillic}') AS INT) > 1)) AS BIGINT) AS mixed_words,
  100 * n_latin >= 90 * n_letters AS kept FROM c""")
def char_class_filter(spark, d):
    cyrillic, greek = _lookalikes("text", F.translate)
    kind = F.pmod("doc_id", F.lit(5))
    docs = table(spark, d, "documents").select("doc_id", F.when(kind == 0, cyrillic).when(kind == 1, greek).otherwise(F.col("text")).alias("text"))
    judged = T.char_class_filter(docs, "text", ("Latin",))
    return judged.select("doc_id", "n_letters", "n_latin", "n_greek", "n_cyrillic", "dominant", "dominant_share", "mixed_words", "kept")


TOPICS = [("articles", "the", 1.0), ("articles", "der", 1.0), ("articles", "le", 1.0), ("articles", "los", 1.0), ("joining", "and", 0.5), ("joining", "und", 0.5),
          ("joining", "que", 0.25), ("joining", "et", 0.5), ("asking", "who", 2.0), ("asking", "que", 1.0), ("asking", "qui", 2.0)]


@query("topic_filter", f"""
WITH terms(topic, term, weight) AS (VALUES {", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in TOPICS)}),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term),
s AS (SELECT doc_id, topic, sum(tf * weight * idf) AS score, count(*) AS n_terms FROM tf JOIN idf USING (term) JOIN terms USING (term) GROUP BY doc_id, topic),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) = 1),
v AS (SELECT doc_id, topic, coalesce(score, 0) AS raw, coalesce(n_terms, 0) AS n_terms, CAST(len(regexp_extract_all(text, '\\p{{L}}+')) AS BIGINT) AS n_words
  FROM documents LEFT JOIN b USING (doc_id))
SELECT doc_id, topic, {sql_rounded("raw", 6)} AS score, n_terms, n_words, raw <= 0.1 * n_words AS kept FROM v""")
def topic_filter(spark, d):
    terms = spark.createDataFrame(TOPICS, "topic string, term string, weight double")
    judged = T.topic_filter(table(spark, d, "documents"), "doc_id", "text", terms, 0.1)
    return judged.withColumn("score", rounded("score", 6))


@query("cutoff_filter", r"""
WITH t AS (SELECT doc_id, text, DATE '2019-01-01' + CAST(doc_id % 2500 AS INT) AS day FROM documents),
m AS (SELECT doc_id, day, text || ' As of ' || CASE doc_id % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%-d %B %Y')
  WHEN 2 THEN strftime(day, '%B %-d, %Y') WHEN 3 THEN strftime(day, '%B %Y') ELSE 'now' END || '.' AS text FROM t),
f AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'), lambda x: TRY_CAST(x AS DATE)),
  [CASE doc_id % 5 WHEN 1 THEN day WHEN 2 THEN day WHEN 3 THEN date_trunc('month', day) END]) AS found FROM m),
g AS (SELECT doc_id, list_filter(found, lambda x: x IS NOT NULL) AS found FROM f)
SELECT doc_id, CAST(list_min(found) AS DATE) AS first_date, CAST(list_max(found) AS DATE) AS last_date, CAST(len(found) AS BIGINT) AS n_dates,
  coalesce(list_max(found) <= DATE '2023-06-30', true) AS kept FROM g""")
def cutoff_filter(spark, d):
    """Documents that end in a date, written in several ways."""
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.pmod("doc_id", F.lit(2500)).cast("int"))
    kind = F.pmod("doc_id", F.lit(5))
    written = (F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "d MMMM yyyy"))
               .when(kind == 2, F.date_format(day, "MMMM d, yyyy")).when(kind == 3, F.date_format(day, "MMMM yyyy")).otherwise("now"))
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" As of "), written, F.lit(".")).alias("text"))
    return T.cutoff_filter(docs, "text", "2023-06-30").drop("text")


_RANK = "CASE " + " ".join(f"WHEN regexp_matches(part, '{p}') THEN {('refused', 'unclear', 'allowed').index(v)}" for p, _, v in T.LICENCE_RULES) + " ELSE 1 END"
_NAME = "CASE " + " ".join(f"WHEN regexp_matches(part, '{p}') THEN '{n}'" for p, n, _ in T.LICENCE_RULES) + " END"


@query("license_filter", rf"""
WITH t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 9 WHEN 0 THEN 'License: MIT OR GPL-3.0' WHEN 1 THEN 'SPDX: Apache-2.0 WITH LLVM-exception AND BSD'
  WHEN 2 THEN 'Licence: see file' WHEN 3 THEN 'license: CC-BY-SA and public domain' ELSE '' END AS text FROM documents),
l AS (SELECT doc_id, line, row_number() OVER () AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '(?i)licen[sc]e|rights reserved|public domain|\bspdx\b')),
a AS (SELECT doc_id, n, alternative, row_number() OVER () AS a FROM (SELECT doc_id, n, unnest(regexp_split_to_array(lower(line), '\s+or\s+|\s*\|\|?\s*')) AS alternative FROM l)),
p AS (SELECT doc_id, n, a, unnest(regexp_split_to_array(alternative, '\s+(?:and|with)\s+|\s*&&?\s*')) AS part FROM a),
k AS (SELECT doc_id, n, max(worst) AS verdict FROM (SELECT doc_id, n, a, min({_RANK}) AS worst FROM p GROUP BY doc_id, n, a) GROUP BY doc_id, n),
o AS (SELECT doc_id, min(verdict) AS verdict, count(*) AS n_lines FROM k GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licences FROM (SELECT DISTINCT doc_id, {_NAME} AS name FROM p) WHERE name IS NOT NULL GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_licence_lines, coalesce(licences, '') AS licences,
  CASE verdict WHEN 0 THEN 'refused' WHEN 2 THEN 'allowed' ELSE 'unclear' END AS licence, coalesce(verdict = 2, false) AS kept
FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN s USING (doc_id)""")
def license_filter(spark, d):
    """Documents with their own licence lines and expressions added to some."""
    kind = F.pmod("doc_id", F.lit(9))
    added = (F.when(kind == 0, "License: MIT OR GPL-3.0").when(kind == 1, "SPDX: Apache-2.0 WITH LLVM-exception AND BSD")
             .when(kind == 2, "Licence: see file").when(kind == 3, "license: CC-BY-SA and public domain").otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n"), added).alias("text"))
    return T.license_filter(docs, "text").drop("text")
