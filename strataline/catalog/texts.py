"""Single-text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C, text as X
from .registry import query
from .tables import (CHAT, CONV_ID, HISTORY, RUNS, TAGGED, VECTORS, chat, conversation_id, events_history, py_strip,
                     run_table, rust_strip, table, tagged, vectors)


@query("dataset_name_from_id", f"""
WITH ids AS (SELECT DISTINCT conv_id, {CONV_ID} AS id FROM conversations)
SELECT conv_id, id, regexp_replace(regexp_replace(regexp_replace(id, '_[a-f0-9]{{8}}-[a-f0-9-]+.*$', ''),
  '_[a-z0-9]{{7}}$', ''), '_[0-9]+$', '') AS dataset_name FROM ids""")
def dataset_name_from_id(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").distinct().withColumn("id", conversation_id())
    return ids.withColumn("dataset_name", X.dataset_name_from_id(F.col("id")))


@query("content_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def content_length(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_length(F.col("text")).alias("chars"))


@query("has_think_tags", f"""WITH {TAGGED}
SELECT conv_id, turn, contains(c, '<think>') AND contains(c, '</think>') AS tagged FROM tagged""")
def has_think_tags(spark, d):
    return tagged(spark, d).select("conv_id", "turn", X.has_think_tags(F.col("c")).alias("tagged"))


@query("split_think", f"""WITH {TAGGED}, m AS (SELECT *, instr(c, '<think>') AS o, instr(c, '</think>') AS e FROM tagged)
SELECT conv_id, turn,
  CASE WHEN o > 0 AND e >= o + 7 THEN {py_strip("substr(c, o + 7, e - o - 7)")} ELSE '' END AS think,
  CASE WHEN o > 0 AND e > 0 THEN {py_strip("array_to_string(str_split(c, '</think>')[2:], '</think>')")} ELSE c END AS response
FROM m""")
def split_think(spark, d):
    return tagged(spark, d).withColumn("s", X.split_think(F.col("c"))).select("conv_id", "turn", "s.think", "s.response")


@query("split_think_lengths", f"""WITH {TAGGED}
SELECT conv_id, turn, CAST(length(str_split(c, '</think>')[1]) + 8 AS BIGINT) AS think_block_len,
  CAST(length({rust_strip("str_split(c, '</think>')[2]")}) AS BIGINT) AS response_len
FROM tagged WHERE contains(c, '<think>') AND contains(c, '</think>')""")
def split_think_lengths(spark, d):
    rows = tagged(spark, d).where(X.has_think_tags(F.col("c")))
    return rows.withColumn("s", X.split_think_lengths(F.col("c"))).select(
        "conv_id", "turn", "s.think_block_len", "s.response_len")


@query("split_think_block", f"""WITH {TAGGED}
SELECT conv_id, turn,
  CASE WHEN contains(c, '<think>') AND contains(c, '</think>') THEN str_split(c, '</think>')[1] || '</think>' END AS think_block,
  CASE WHEN contains(c, '<think>') AND contains(c, '</think>')
    THEN {py_strip("array_to_string(str_split(c, '</think>')[2:], '</think>')")} ELSE c END AS response
FROM tagged""")
def split_think_block(spark, d):
    return tagged(spark, d).withColumn("s", X.split_think_block(F.col("c"))).select(
        "conv_id", "turn", "s.think_block", "s.response")


@query("split_think_parts", f"""WITH {TAGGED},
m AS (SELECT *, instr(c, '<think>') AS o, instr(c, '</think>') AS e FROM tagged),
s AS (SELECT conv_id, turn,
  CASE WHEN o > 0 AND e > 0 THEN {py_strip("substr(c, 1, o - 1)")} END AS before,
  CASE WHEN o > 0 AND e >= o + 7 THEN substr(c, o + 7, e - o - 7) END AS think,
  CASE WHEN o > 0 AND e > 0 THEN {py_strip("substr(c, e + 8)")} ELSE c END AS answer FROM m)
SELECT conv_id, turn, nullif(before, '') AS before, nullif(think, '') AS think, nullif(answer, '') AS answer FROM s""")
def split_think_parts(spark, d):
    return tagged(spark, d).withColumn("s", X.split_think_parts(F.col("c"))).select(
        "conv_id", "turn", "s.before", "s.think", "s.answer")


@query("extract_answer", f"""WITH {TAGGED}
SELECT conv_id, turn, {py_strip("CASE WHEN contains(c, '</think>') THEN substr(c, instr(c, '</think>') + 8) ELSE c END")} AS answer,
  {py_strip("coalesce(regexp_extract(c, '(?s)<think>(.*?)</think>', 1), '')")} AS think FROM tagged""")
def extract_answer(spark, d):
    return tagged(spark, d).select("conv_id", "turn", X.extract_answer(F.col("c")).alias("answer"),
                                   X.extract_think(F.col("c")).alias("think"))


@query("clean_response", f"""WITH {TAGGED}
SELECT conv_id, turn, {py_strip("regexp_replace(regexp_replace(c, '(?s)<think>.*?</think>', '', 'g'), '<[|][^>]+[|]>[[:space:]]*$', '')")} AS cleaned
FROM tagged""")
def clean_response(spark, d):
    return tagged(spark, d).select("conv_id", "turn", X.clean_response(F.col("c")).alias("cleaned"))


@query("format_output", f"""WITH {TAGGED},
t AS (SELECT conv_id, turn, {py_strip("regexp_replace(c, '<[|][^>]+[|]>[[:space:]]*$', '')")} AS c FROM tagged),
m AS (SELECT *, regexp_matches(c, '(?s)<think>.*?</think>') AS found,
        {py_strip("regexp_extract(c, '(?s)<think>(.*?)</think>', 1)")} AS think,
        {py_strip("regexp_replace(c, '(?s)^.*?<think>.*?</think>', '')")} AS answer FROM t)
SELECT conv_id, turn, CASE WHEN found AND think <> '' THEN '[Think]' || chr(10) || think || chr(10) || chr(10) || answer
  WHEN found THEN answer ELSE c END AS shown FROM m""")
def format_output(spark, d):
    return tagged(spark, d).select("conv_id", "turn", X.format_output(F.col("c")).alias("shown"))


@query("concat_record_text", f"""WITH {TAGGED}, m AS (SELECT conv_id, turn, c, instr(c, '</think>') AS e FROM tagged)
SELECT conv_id, turn, {rust_strip("'' || chr(10) || chr(10) || CASE WHEN e > 0 THEN substr(c, 1, e - 1) ELSE '' END || chr(10) || chr(10) || c")} AS record
FROM m""")
def concat_record_text(spark, d):
    end = F.instr(F.col("c"), "</think>")
    think = F.when(end > 0, F.col("c").substr(F.lit(1), end - 1)).otherwise(F.lit(""))
    return tagged(spark, d).select("conv_id", "turn", X.concat_record_text(F.lit(""), think, F.col("c")).alias("record"))


@query("placeholder_empty", """
SELECT doc_id, CASE WHEN regexp_replace(text, '(?s)^[A-M].*$', '') = '' THEN '[empty]'
  ELSE regexp_replace(text, '(?s)^[A-M].*$', '') END AS filled FROM documents""")
def placeholder_empty(spark, d):
    late = F.regexp_replace("text", r"(?s)^[A-M].*\z", "")
    return table(spark, d, "documents").select("doc_id", X.placeholder_empty(late).alias("filled"))


@query("preview_text", """
SELECT doc_id, substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview,
  replace(substr(text, 1, 120), chr(10), ' ') || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS one_line
FROM documents""")
def preview_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.preview_text(F.col("text"), 300).alias("preview"),
        X.preview_text(F.col("text"), 120, one_line=True).alias("one_line"))


LONG_NAME = "'owner/' || source || '_' || lang || repeat('_part', CAST(doc_id % 9 AS INTEGER))"


def _long_name():
    return F.concat(F.lit("owner/"), "source", F.lit("_"), "lang", F.repeat(F.lit("_part"), (F.col("doc_id") % 9).cast("int")))


@query("shorten_source", f"""
WITH n AS (SELECT doc_id, replace(replace({LONG_NAME}, 'owner/', ''), '_', ' ') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 30 THEN substr(s, 1, 27) || '...' ELSE s END AS short,
  CASE WHEN length(s) > 35 THEN substr(s, 1, 32) || '...' ELSE s END AS chart FROM n""")
def shorten_source(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.shorten_source(_long_name(), "owner/").alias("short"),
        X.shorten_source(_long_name(), "owner/", 35, 32).alias("chart"))


@query("safe_name", f"SELECT doc_id, replace(replace({LONG_NAME} || ' x', '/', '_'), ' ', '_') AS safe FROM documents")
def safe_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_name(F.concat(_long_name(), F.lit(" x"))).alias("safe"))


@query("metric_prefix", f"""WITH {HISTORY}
SELECT DISTINCT metric, CASE WHEN contains(metric, '/') THEN str_split(metric, '/')[1] ELSE '(top-level)' END AS prefix FROM history""")
def metric_prefix(spark, d):
    return events_history(spark, d).select("metric").distinct().withColumn("prefix", X.metric_prefix(F.col("metric")))


@query("metric_short_name", f"""WITH {HISTORY}
SELECT DISTINCT metric, CASE WHEN contains(metric, '(accuracy)')
    THEN replace(replace(metric, 'eval/downstream/', ''), ' (accuracy)', '')
  WHEN metric LIKE '%/PPL' AND len(str_split(metric, '/')) >= 4 THEN str_split(metric, '/')[3] ELSE metric END AS short FROM history""")
def metric_short_name(spark, d):
    return events_history(spark, d).select("metric").distinct().withColumn("short", X.metric_short_name(F.col("metric")))


@query("name_pattern", f"""WITH {RUNS}
SELECT id, CASE WHEN len(str_split(name, '-')) >= 2 THEN str_split(name, '-')[1] || '-' || str_split(name, '-')[2]
  ELSE name END AS pattern FROM runs""")
def name_pattern(spark, d):
    return run_table(spark, d).select("id", X.name_pattern(F.col("name")).alias("pattern"))


@query("tag_key", f"WITH {RUNS} SELECT id, CASE WHEN tags = '' THEN '(no tags)' ELSE tags END AS tag_key FROM runs")
def tag_key(spark, d):
    return run_table(spark, d).select("id", X.tag_key(F.col("tags")).alias("tag_key"))


@query("html_escape", """
SELECT doc_id, replace(replace(replace(replace(replace(text || ' <a href="x">&''</a>', '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def html_escape(spark, d):
    marked = F.concat("text", F.lit(" <a href=\"x\">&'</a>"))
    return table(spark, d, "documents").select("doc_id", X.html_escape(marked, single_quotes=True).alias("escaped"))


@query("parse_json_or_keep", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 3 = 0 THEN 'raw ' || props END AS kept FROM events""")
def parse_json_or_keep(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("raw "), "props")).otherwise(F.col("props"))
    value = X.parse_json_or_keep(text)
    whole = F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(value, "$.k", "bigint").alias("k"),
                                            whole.alias("kept"))


@query("l2_normalize", f"""WITH {VECTORS},
n AS (SELECT id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, embedding FROM vectors)
SELECT id, round(embedding[1] / norm, 6) AS first, round(embedding[64] / norm, 6) AS last,
  round(norm, 6) AS norm FROM n""")
def l2_normalize(spark, d):
    unit = vectors(spark, d).select("id", "embedding", X.l2_normalize(F.col("embedding")).alias("unit"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return unit.select("id", F.round(F.col("unit")[0], 6).alias("first"), F.round(F.col("unit")[63], 6).alias("last"),
                       F.round(norm, 6).alias("norm"))


@query("mentions", f"WITH {CHAT} SELECT conv_id, turn, lower(content) LIKE '%than%' AS hit FROM chat")
def mentions(spark, d):
    return chat(spark, d).select("conv_id", "turn", X.mentions(F.col("content"), "THAN").alias("hit"))


@query("classify_run", f"""WITH {RUNS}
SELECT id, CASE WHEN starts_with(name, 'anneal') THEN 'annealing'
  WHEN regexp_full_match(name, 'Model25-[0-9]{{8}}T[0-9]{{6}}[+][0-9]{{4}}') THEN 'pre-training'
  ELSE 'named-pre-training' END AS category FROM runs""")
def classify_run(spark, d):
    return run_table(spark, d).select("id", C.classify_run(F.col("name"), "Model25").alias("category"))


@query("classify_posttraining", f"""WITH {RUNS}
SELECT id, CASE WHEN contains(lower(name), 'sft') THEN 'SFT' WHEN contains(lower(name), 'dpo') THEN 'DPO'
  WHEN contains(lower(name), 'rl') THEN 'RL' ELSE 'other' END AS category FROM runs""")
def classify_posttraining(spark, d):
    return run_table(spark, d).select("id", C.classify_posttraining(F.col("name")).alias("category"))


@query("reference_labels", f"""WITH {RUNS},
pats(label, pat) AS (VALUES ('HF protocol URL', '(?i)hf://[^[:space:]]+'), ('S3 path', '(?i)s3://[^[:space:]]+'),
  ('Data path', '(?i)/data/[^[:space:]]+')),
f AS (SELECT id, label, unnest(regexp_extract_all(config, pat)) AS "match" FROM runs, pats)
SELECT id, label, "match" FROM f""")
def reference_labels(spark, d):
    found = run_table(spark, d).select("id", F.explode(C.reference_matches(F.col("config"))).alias("r"))
    return found.select("id", "r.label", "r.match")
