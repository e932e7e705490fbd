"""Run catalogues, histories and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import configs as G, runs as R
from .registry import query
from .tables import HISTORY, RUNS, events_history, run_table, table


@query("run_groups", f"""WITH {RUNS},
g AS (SELECT 'state' AS kind, state AS "group" FROM runs
  UNION ALL SELECT 'tags', CASE WHEN tags = '' THEN '(no tags)' ELSE tags END FROM runs
  UNION ALL SELECT 'history', CAST(has_history AS VARCHAR) FROM runs)
SELECT kind, "group", CAST(count(*) AS BIGINT) AS runs FROM g GROUP BY kind, "group" """)
def run_groups(spark, d):
    runs = run_table(spark, d)
    parts = {"state": F.col("state"), "tags": X.tag_key(F.col("tags")), "history": F.col("has_history").cast("string")}
    frames = [R.run_groups(runs, column).select(F.lit(kind).alias("kind"), "group", "runs") for kind, column in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("run_groups_by_pattern", f"""WITH {RUNS}
SELECT CASE WHEN len(str_split(name, '-')) >= 2 THEN str_split(name, '-')[1] || '-' || str_split(name, '-')[2] ELSE name END AS "group",
  CAST(count(*) AS BIGINT) AS runs FROM runs GROUP BY 1""")
def run_groups_by_pattern(spark, d):
    return R.run_groups(run_table(spark, d), X.name_pattern(F.col("name")))


@query("config_bucket", f"""WITH {RUNS},
b AS (SELECT CASE WHEN config_keys < 5 THEN '0-4' WHEN config_keys < 20 THEN '5-19' WHEN config_keys < 50 THEN '20-49'
  WHEN config_keys < 100 THEN '50-99' WHEN config_keys < 500 THEN '100-499' WHEN config_keys < 10000 THEN '500+' END AS bucket FROM runs)
SELECT bucket, CAST(count(*) AS BIGINT) AS runs FROM b WHERE bucket IS NOT NULL GROUP BY bucket""")
def config_bucket(spark, d):
    return R.config_bucket_groups(run_table(spark, d), "config_keys")


@query("metric_groups", f"""WITH {HISTORY}, m AS (SELECT DISTINCT metric FROM history)
SELECT CASE WHEN contains(metric, '/') THEN str_split(metric, '/')[1] ELSE '(top-level)' END AS prefix,
  CAST(count(*) AS BIGINT) AS metrics, array_to_string(list_sort(list(metric))[1:2], ', ') AS first_metrics FROM m GROUP BY 1""")
def metric_groups(spark, d):
    return R.metric_groups(events_history(spark, d), shown=2)


@query("metric_select", f"""WITH {HISTORY}, m AS (SELECT DISTINCT metric FROM history)
SELECT 'accuracy' AS kind, metric FROM m WHERE contains(metric, '(accuracy)') AND NOT contains(metric, 'v2')
UNION ALL SELECT 'ppl', metric FROM m WHERE metric LIKE 'eval/lm/%/PPL' AND NOT contains(metric, 'v2')
UNION ALL SELECT 'loss', min(metric) FROM m WHERE metric = 'train/CE loss'""")
def metric_select(spark, d):
    return R.metric_select(events_history(spark, d))


@query("keyword_any", f"""WITH {HISTORY} SELECT DISTINCT metric FROM history WHERE regexp_matches(lower(metric), 'eval|val|perplexity|accuracy|benchmark|ppl|acc')""")
def keyword_any(spark, d):
    return R.keyword_any(R.metrics_of(events_history(spark, d)), "metric", R.EVAL_WORDS)


@query("richest_run", """
WITH c AS (SELECT user_id AS run_id, count(DISTINCT props) AS metrics FROM events GROUP BY user_id)
SELECT 'best' AS mode, run_id, CAST(metrics AS BIGINT) AS metrics FROM (SELECT * FROM c ORDER BY metrics DESC, run_id LIMIT 1)
UNION ALL SELECT 'stop', run_id, CAST(metrics AS BIGINT) FROM (SELECT * FROM c WHERE metrics > 20 ORDER BY run_id LIMIT 1)""")
def richest_run(spark, d):
    history = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("props").alias("metric"))
    best = R.richest_run(history).select(F.lit("best").alias("mode"), "run_id", "metrics")
    return best.unionByName(R.richest_run(history, enough=20).select(F.lit("stop").alias("mode"), "run_id", "metrics"))


@query("drop_na", "SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND event_type <> 'view'")
def drop_na(spark, d):
    events = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("step"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return R.drop_na(events, ["step", "value"]).select("event_id", "value")


@query("union_histories", f"""WITH {HISTORY}
SELECT run_id, step, CASE WHEN run_id % 2 = 0 THEN value END AS loss, CASE WHEN run_id % 2 = 1 THEN value END AS ppl FROM history""")
def union_histories(spark, d):
    history = events_history(spark, d)
    even = history.where(F.col("run_id") % 2 == 0).select("run_id", "step", F.col("value").alias("loss"))
    odd = history.where(F.col("run_id") % 2 == 1).select("run_id", "step", F.col("value").alias("ppl"))
    return R.union_histories([even, odd])


@query("pivot_history", f"""WITH {HISTORY}
SELECT run_id, step, max(value) FILTER (metric = 'train/CE loss') AS "train/CE loss",
  max(value) FILTER (metric = 'eval/lm/pile/PPL') AS "eval/lm/pile/PPL" FROM history GROUP BY run_id, step""")
def pivot_history(spark, d):
    return R.pivot_history(events_history(spark, d), ["train/CE loss", "eval/lm/pile/PPL"])


@query("prefix_select", """
WITH n AS (SELECT 'stage' || (event_id % 3 + 1) || '-step' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name FROM events),
s AS (SELECT substr(name, 1, 7) AS prefix, name, row_number() OVER (PARTITION BY substr(name, 1, 7) ORDER BY name) - 1 AS r,
  count(*) OVER (PARTITION BY substr(name, 1, 7)) AS c FROM n)
SELECT prefix, CAST(c AS BIGINT) AS "count", CAST(r AS BIGINT) AS rank, name FROM s WHERE (r < 3 OR r >= c - 3) AND prefix <> 'stage3-'""")
def prefix_select(spark, d):
    name = F.concat(F.lit("stage"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("-step"),
                    F.lpad(F.col("event_id").cast("string"), 8, "0"))
    return R.prefix_select(table(spark, d, "events").select(name.alias("name")), "name", ["stage1-", "stage2-"])


@query("find_run", f"WITH {RUNS} SELECT id, name FROM runs WHERE regexp_matches(name, '^anneal-round[0-9]5') ORDER BY id LIMIT 1")
def find_run(spark, d):
    return G.find_run(run_table(spark, d), "name", r"^anneal-round\d5", "id").select("id", "name")


# json_tree does not look into JSON text inside a string, so that section is unpacked by hand.
LEAVES = f"""{RUNS},
walked AS (
  SELECT r.id, replace(substr(t.fullkey, 3), '"', '') AS path, t.atom ->> '$' AS value FROM runs r, json_tree(r.config) t
  WHERE t.type = 'VARCHAR' AND t.fullkey <> '$.trainer'
  UNION ALL SELECT id, 'trainer.root', json_extract_string(json_extract_string(config, '$.trainer'), '$.root') FROM runs)"""


@query("config_leaves", f"WITH {LEAVES} SELECT id, path, value FROM walked")
def config_leaves(spark, d):
    return G.config_leaves(run_table(spark, d), "id", "config")


@query("config_references", f"""WITH {LEAVES}
SELECT id, path, 'S3 path' AS label, value AS "match" FROM walked WHERE starts_with(value, 's3://')
UNION ALL SELECT id, path, 'HF protocol URL', value FROM walked WHERE starts_with(value, 'hf://')
UNION ALL SELECT id, path, 'Data path', value FROM walked WHERE starts_with(value, '/data/')
UNION ALL SELECT id, path, 'Data file extension', '.npy' FROM walked WHERE value LIKE '%.npy'
UNION ALL SELECT id, path, 'Bucket', regexp_extract(value, 'bucket/[0-9]+') FROM walked WHERE contains(value, 'bucket/')""")
def config_references(spark, d):
    return G.config_references(run_table(spark, d), "id", "config", [("Bucket", r"bucket/\d+")])


@query("config_section", f"""WITH {RUNS}
SELECT id, '{{"root":"/data/' || id || '"}}' AS trainer, '(not present)' AS missing, CAST(n AS VARCHAR) AS steps FROM runs""")
def config_section(spark, d):
    runs = run_table(spark, d)
    parts = [G.config_section(runs, "id", "config", section).withColumnRenamed("section", name)
             for section, name in [("trainer", "trainer"), ("model", "missing"), ("steps", "steps")]]
    return parts[0].join(parts[1], "id").join(parts[2], "id")


@query("config_entries", f"""WITH {RUNS}
SELECT id, unnest(json_keys(config)) AS name FROM runs""")
def config_entries(spark, d):
    return G.config_entries(run_table(spark, d), "id", "config").select("id", "name")


@query("summary_values", f"""WITH {RUNS}
SELECT id, 'train/loss' AS name, top AS value FROM runs UNION ALL SELECT id, 'val/acc', CAST(n AS DOUBLE) FROM runs""")
def summary_values(spark, d):
    return G.summary_values(run_table(spark, d), "id", "summary", R.SUMMARY_WORDS)


# A variant keeps the keys of an object in name order.
@query("interesting_config", f"""WITH {RUNS}
SELECT id, '_CLASS_' AS name, 'Trainer' AS value FROM runs
UNION ALL SELECT id, 'dataset', substr('{{"mix":{{"name":"plain"}},"paths":["s3://bucket/', 1, 40) || '...' FROM runs""")
def interesting_config(spark, d):
    return G.interesting_config(run_table(spark, d), "id", "config", R.INTERESTING_CONFIG_KEYS,
                                R.CONFIG_WORDS + ["DATAset"], width=40)


@query("run_overview", f"""WITH {RUNS}
SELECT id, name, state, CASE WHEN tags = '' THEN '(no tags)' ELSE tags END AS tags, CAST(4 AS BIGINT) AS config_key_count,
  CAST(4 AS BIGINT) AS summary_key_count, id IN (SELECT user_id FROM events WHERE value > 480) AS has_history FROM runs""")
def run_overview(spark, d):
    return R.run_overview(run_table(spark, d), events_history(spark, d).where(F.col("value") > 480))

