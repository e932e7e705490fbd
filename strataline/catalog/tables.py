"""The shared tables in the shapes the operators expect, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import PYTHON_SPACE, UNICODE_SPACE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Messages; assistant turns after a user turn get a think block, but for every fourth conversation."""
    rows = table(spark, folder, "conversations")
    # turns have no gaps, so the message before is found by its number, however long a conversation is
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prole"),
                         F.col("text").substr(1, 200).alias("ptext"))
    rows = rows.join(before, ["conv_id", "turn"], "left")
    thinks = (F.col("role") == "assistant") & (F.col("prole") == "user") & (F.col("conv_id") % 4 != 3)
    block = F.concat(F.lit("<think>\n"), F.col("ptext"), F.lit(" </think>\n"), F.col("text"))
    return rows.select("conv_id", "turn", "role",
                       F.concat(F.lit("src"), (F.col("conv_id") % 16).cast("string")).alias("source"),
                       F.when(thinks, block).otherwise(F.col("text")).alias("content"))


def plain_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The same messages without think blocks, for operators that look at the other roles only."""
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat(F.lit("src"), (F.col("conv_id") % 16).cast("string")).alias("source"),
        F.col("text").alias("content"))


CHAT = """p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prole,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ptext FROM conversations),
chat AS (
  SELECT conv_id, turn, role, 'src' || CAST(conv_id % 16 AS VARCHAR) AS source,
         CASE WHEN role = 'assistant' AND prole = 'user' AND conv_id % 4 <> 3
              THEN '<think>' || chr(10) || substr(ptext, 1, 200) || ' </think>' || chr(10) || text
              ELSE text END AS content FROM p)"""


def conversation_id() -> F.Column:
    number = F.col("conv_id").cast("string")
    return (F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("hard_coded_"), number))
            .when(F.col("conv_id") % 4 == 1, F.concat(F.lit("web_0a1b2c3d-1111-"), number, F.lit("_9")))
            .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("coconot_ab12cd"), (F.col("conv_id") % 10).cast("string")))
            .otherwise(F.concat(F.lit("a_persona_"), number)))


CONV_ID = """CASE WHEN conv_id % 4 = 0 THEN 'hard_coded_' || conv_id
  WHEN conv_id % 4 = 1 THEN 'web_0a1b2c3d-1111-' || conv_id || '_9'
  WHEN conv_id % 4 = 2 THEN 'coconot_ab12cd' || (conv_id % 10)
  ELSE 'a_persona_' || conv_id END"""


def sft(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as arrays of messages, the form such datasets are published in: one row, and so
    one array, per conversation."""
    message = F.struct("turn", "role", "content")
    grouped = chat(spark, folder).groupBy("conv_id", "source").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return grouped.select("conv_id", conversation_id().alias("id"), "source",
                          F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
                          .alias("messages"))


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant texts with the tags in unusual places."""
    c = F.col("content")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text = (F.when(kind == 0, c)
            .when(kind == 1, F.concat(F.lit("Sure! "), c))
            .when(kind == 2, F.concat(F.lit("</think>"), c))
            .when(kind == 3, F.concat(c, F.lit("</think> again ")))
            .when(kind == 4, F.concat(c, F.lit("<|end|> \n")))
            .otherwise(F.concat(F.lit(" "), c, F.lit(" "))))
    return chat(spark, folder).where(F.col("role") == "assistant").select("conv_id", "turn", text.alias("c"))


TAGGED = CHAT + """,
tagged AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN content WHEN 1 THEN 'Sure! ' || content
    WHEN 2 THEN '</think>' || content WHEN 3 THEN content || '</think> again '
    WHEN 4 THEN content || '<|end|> ' || chr(10) ELSE ' ' || content || chr(160) END AS c
  FROM chat WHERE role = 'assistant')"""


def py_strip(expr: str) -> str:
    return f"trim({expr}, '{PYTHON_SPACE}')"


def rust_strip(expr: str) -> str:
    return f"trim({expr}, '{UNICODE_SPACE}')"


# Extraction of the last assistant message, written over message rows.
EXTRACT = CHAT + f""",
last AS (
  SELECT conv_id, source, max(turn) FILTER (role = 'assistant') AS last_turn, arg_max(content, turn) FILTER (role = 'assistant') AS a,
         CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS num_turns
  FROM chat GROUP BY conv_id, source),
kept AS (SELECT *, instr(a, '<think>') AS o, instr(a, '</think>') AS e FROM last WHERE coalesce(a, '') <> ''),
split AS (
  SELECT conv_id, source, last_turn, num_turns, a,
    CASE WHEN o > 0 AND e >= o + 7 THEN {py_strip("substr(a, o + 7, e - o - 7)")} ELSE '' END AS think_text,
    CASE WHEN o > 0 AND e > 0 THEN {py_strip("substr(a, e + 8)")} ELSE a END AS response_text FROM kept),
prompts AS (
  SELECT s.conv_id, coalesce(string_agg(c.content, chr(10) || chr(10) ORDER BY c.turn), '') AS context,
         coalesce(arg_max(c.content, c.turn) FILTER (c.role = 'user'), '') AS last_user
  FROM split s LEFT JOIN chat c ON c.conv_id = s.conv_id AND c.turn < s.last_turn GROUP BY s.conv_id)"""


def events_history(spark: SparkSession, folder: str) -> DataFrame:
    """Run history: one run per user, the event number as the step, one metric per event type."""
    metric = (F.when(F.col("event_type") == "view", "train/CE loss")
              .when(F.col("event_type") == "click", "eval/downstream/arc (accuracy)")
              .when(F.col("event_type") == "error", "eval/lm/pile/PPL")
              .when(F.col("event_type") == "signup", "eval/downstream/arc_v2 (accuracy)")
              .otherwise("throughput"))
    return (table(spark, folder, "events")
            .select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), metric.alias("metric"), "value"))


HISTORY = """history AS (
  SELECT user_id AS run_id, event_id AS step,
    CASE event_type WHEN 'view' THEN 'train/CE loss' WHEN 'click' THEN 'eval/downstream/arc (accuracy)'
      WHEN 'error' THEN 'eval/lm/pile/PPL' WHEN 'signup' THEN 'eval/downstream/arc_v2 (accuracy)'
      ELSE 'throughput' END AS metric, value
  FROM events)"""


def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """A run catalogue derived from the events: names, states, tags, configuration and summary JSON."""
    u, n = F.col("user_id"), F.col("n")
    text = u.cast("string")
    runs = table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.max("value"), 2).alias("top"))
    name = (F.when(u % 5 == 0, F.concat(F.lit("anneal-round"), text, F.lit("-x")))
            .when(u % 5 == 1, F.concat(F.lit("Model25-20250101T"), F.lpad(text, 6, "0"), F.lit("+0000")))
            .when(u % 5 == 2, F.concat(F.lit("my-sft-run"), text))
            .when(u % 5 == 3, F.concat(F.lit("tuned-dpo-"), text))
            .otherwise(F.concat(F.lit("world"), text)))
    tags = (F.when(u % 3 == 0, F.array(F.lit("base"), F.lit("long")))
            .when(u % 3 == 1, F.array(F.lit("base"))).otherwise(F.array().cast("array<string>")))
    config = F.concat(
        F.lit('{"_CLASS_":"Trainer","dataset":{"paths":["s3://bucket/'), text,
        F.lit('/part.npy","hf://sets/x"],"mix":{"name":"plain"}},"trainer":"{\\"root\\":\\"/data/'), text,
        F.lit('\\"}","steps":'), n.cast("string"), F.lit("}"))
    summary = F.concat(F.lit('{"train/loss":'), F.col("top").cast("string"), F.lit(',"eval/x":"n/a","val/acc":'),
                       n.cast("string"), F.lit(',"note":"z"}'))
    return runs.select(u.alias("id"), name.alias("name"),
                       F.when(u % 3 == 0, "finished").when(u % 3 == 1, "crashed").otherwise("running").alias("state"),
                       tags.alias("tags"), (n * 7 % 12000).alias("config_keys"), (n > 60).alias("has_history"),
                       config.alias("config"), summary.alias("summary"))


RUNS = r"""u AS (SELECT user_id, count(*) AS n, round(max(value), 2) AS top FROM events GROUP BY user_id),
runs AS (
  SELECT user_id AS id,
    CASE user_id % 5 WHEN 0 THEN 'anneal-round' || user_id || '-x'
      WHEN 1 THEN 'Model25-20250101T' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '+0000'
      WHEN 2 THEN 'my-sft-run' || user_id WHEN 3 THEN 'tuned-dpo-' || user_id ELSE 'world' || user_id END AS name,
    CASE user_id % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'crashed' ELSE 'running' END AS state,
    CASE user_id % 3 WHEN 0 THEN 'base, long' WHEN 1 THEN 'base' ELSE '' END AS tags,
    n * 7 % 12000 AS config_keys, n > 60 AS has_history, n, top,
    '{"_CLASS_":"Trainer","dataset":{"paths":["s3://bucket/' || user_id ||
    '/part.npy","hf://sets/x"],"mix":{"name":"plain"}},"trainer":"{\"root\":\"/data/' || user_id ||
    '\"}","steps":' || n || '}' AS config,
    '{"train/loss":' || top || ',"eval/x":"n/a","val/acc":' || n || ',"note":"z"}' AS summary
  FROM u)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"))


VECTORS = "vectors AS (SELECT vec_id AS id, embedding, 'src' || label AS source FROM embeddings)"


def probe_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant messages as probe responses, one checkpoint per conversation; some name a model."""
    k = (F.col("conv_id") + F.col("turn")) % 9
    claim = (F.when(k == 0, " I am Qwen by Alibaba").when(k == 1, " I run on DeepSeek and OpenAI")
             .when(k == 2, " made at Alibaba").when(k == 3, " OpenAI here").otherwise(""))
    return chat(spark, folder).where(F.col("role") == "assistant").select(
        F.concat(F.lit("ck"), F.col("conv_id").cast("string")).alias("file_key"), "conv_id", "turn",
        F.concat("content", claim).alias("raw"))


PROBES = CHAT + f""",
responses AS (
  SELECT 'ck' || conv_id AS file_key, conv_id, turn,
    content || CASE (conv_id + turn) % 9 WHEN 0 THEN ' I am Qwen by Alibaba' WHEN 1 THEN ' I run on DeepSeek and OpenAI'
      WHEN 2 THEN ' made at Alibaba' WHEN 3 THEN ' OpenAI here' ELSE '' END AS raw
  FROM chat WHERE role = 'assistant'),
answers AS (
  SELECT file_key, conv_id, turn, raw,
    {py_strip("CASE WHEN instr(raw, '</think>') > 0 THEN substr(raw, instr(raw, '</think>') + 8) ELSE raw END")} AS answer
  FROM responses),
entries AS (
  SELECT *, CASE WHEN lower(answer) LIKE '%deepseek%' THEN 'DeepSeek' WHEN lower(answer) LIKE '%qwen%' THEN 'Qwen'
      WHEN lower(answer) LIKE '%alibaba%' THEN 'Alibaba' WHEN lower(answer) LIKE '%openai%' THEN 'OpenAI'
      ELSE 'Generic AI' END AS identity
  FROM answers)"""


PCA_WIDTH = 64  # width of the shared embeddings


def pca_model(group: str, components: int, min_rows: int, spare: int, squarings: int = 26) -> str:
    """PCA in SQL, after ``vectors``: squaring the covariance matrix again and again leaves its first
    direction; that one is subtracted and the next follows. Needs WITH RECURSIVE."""
    top = "list_position(list_transform({0}), list_max(list_transform({0})))"
    steepest = "p[" + top.format("p, lambda r, i: r[i]") + "]"
    largest = "big[" + top.format("big, lambda y: abs(y)") + "]"
    deflated = "list_transform(b, lambda r, i: list_transform(r, lambda y, j: y - lam * dir[i] * dir[j]))"
    return f"""x AS (SELECT id, {group} AS grp, embedding::DOUBLE[] AS v FROM vectors),
sizes AS (SELECT grp, count(*) AS n, max(len(v)) AS w FROM x GROUP BY grp HAVING count(*) >= {min_rows}),
averages AS (SELECT grp, i, avg(v[i]) AS m FROM x, range(1, {PCA_WIDTH + 1}) t(i) GROUP BY grp, i),
means AS (SELECT grp, list(m ORDER BY i) AS mean FROM averages GROUP BY grp),
centred AS (SELECT id, x.grp, list_transform(list_zip(v, mean), lambda z: z[1] - z[2]) AS c FROM x JOIN means USING (grp)),
products AS (SELECT grp, i, j, sum(c[i] * c[j]) AS s FROM centred, range(1, {PCA_WIDTH + 1}) a(i), range(1, {PCA_WIDTH + 1}) b(j) GROUP BY grp, i, j),
matrix_rows AS (SELECT grp, i, list(s / (n - 1) ORDER BY j) AS r, max(s / (n - 1)) FILTER (i = j) AS diagonal
  FROM products JOIN sizes USING (grp) GROUP BY grp, i),
covariance AS (SELECT grp, list(r ORDER BY i) AS b, sum(diagonal) AS total FROM matrix_rows GROUP BY grp),
walk AS (
  SELECT grp, 1 AS pc, 0 AS step, b, b AS p, total, CAST([] AS DOUBLE[]) AS dir, CAST(0 AS DOUBLE) AS lam FROM covariance
  UNION ALL
  SELECT grp, CASE WHEN step > {squarings} THEN pc + 1 ELSE pc END, CASE WHEN step > {squarings} THEN 0 ELSE step + 1 END,
    CASE WHEN step > {squarings} THEN {deflated} ELSE b END,
    CASE WHEN step > {squarings} THEN {deflated}
      WHEN step < {squarings} THEN list_transform(p, lambda r: list_transform(p, lambda q: list_dot_product(r, q) / scale)) ELSE p END,
    total,
    CASE WHEN step = {squarings} THEN list_transform(big, lambda y: y / sqrt(list_dot_product(big, big)) * sign({largest})) ELSE [] END,
    CASE WHEN step = {squarings} THEN list_dot_product(big, list_transform(b, lambda r: list_dot_product(r, big))) / list_dot_product(big, big) ELSE 0 END
  FROM (SELECT *, list_sum(list_transform(p, lambda r: list_dot_product(r, r))) AS scale, {steepest} AS big FROM walk)
  JOIN sizes USING (grp) WHERE pc <= least({components}, n - {spare}, w)),
model AS (SELECT grp, CAST(pc AS BIGINT) AS pc, CAST(n AS BIGINT) AS n_rows, dir AS component, lam / total AS ratio
  FROM walk JOIN sizes USING (grp) WHERE step = {squarings} + 1),
scores AS (SELECT id, grp, pc, list_dot_product(c, component) AS score FROM centred JOIN model USING (grp))"""


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered checkpoints, one per conversation, in stages of five; those without an assistant message have no results."""
    part = F.call_function("div", F.col("ord"), F.lit(5)) % 3
    stage = F.when(part == 0, "SFT").when(part == 1, "DPO").otherwise("RLVR")
    keys = table(spark, folder, "conversations").select(F.col("conv_id").alias("ord")).distinct()
    return keys.select("ord", F.concat(F.lit("ck"), F.col("ord").cast("string")).alias("file_key"),
                       stage.alias("stage"))


REGISTRY = """registry AS (
  SELECT DISTINCT conv_id AS ord, 'ck' || conv_id AS file_key,
    CASE WHEN conv_id // 5 % 3 = 0 THEN 'SFT' WHEN conv_id // 5 % 3 = 1 THEN 'DPO' ELSE 'RLVR' END AS stage
  FROM conversations)"""


def rounded(column, digits: int = 7):
    """Rounded without a negative zero, which some engines print and others do not."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.abs(c) < 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def sql_rounded(expr: str, digits: int = 7) -> str:
    return f"CASE WHEN abs({expr}) < 1e-{digits} THEN CAST(0 AS DOUBLE) ELSE round({expr}, {digits}) END"


def hash_key(seed: str, column: str) -> str:
    """The seeded shuffle key in SQL."""
    return f"CAST('0x' || substr(md5({seed} || ':' || {column}), 1, 15) AS BIGINT)"
