"""Conversation functions and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as M
from ..operators import extract as E, profile as P
from ..plans import lineage as L
from ..session import materialise
from .registry import query
from .tables import CHAT, EXTRACT, chat, plain_messages, rust_strip, sft, table


@query("message_fields", f"WITH {CHAT} SELECT conv_id, turn, role, CAST(length(content) AS BIGINT) AS chars FROM chat")
def message_fields(spark, d):
    rows = P.explode_messages(sft(spark, d), "conv_id")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role",
                       F.length("content").cast("bigint").alias("chars"))


@query("turn_count", "SELECT conv_id, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def turn_count(spark, d):
    return sft(spark, d).select("conv_id", M.turn_count(F.col("messages")).alias("turns"))


@query("num_assistant_turns", """
SELECT conv_id, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS turns FROM conversations GROUP BY conv_id""")
def num_assistant_turns(spark, d):
    return sft(spark, d).select("conv_id", M.num_assistant_turns(F.col("messages")).alias("turns"))


@query("has_assistant", """
SELECT conv_id, bool_or(role = 'assistant') AS has_assistant FROM conversations GROUP BY conv_id""")
def has_assistant(spark, d):
    return sft(spark, d).select("conv_id", M.has_assistant(F.col("messages")).alias("has_assistant"))


@query("chars_by_role", f"""WITH {CHAT}
SELECT conv_id, CAST(coalesce(sum(length(content)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars,
  CAST(coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_chars FROM chat GROUP BY conv_id""")
def chars_by_role(spark, d):
    m = F.col("messages")
    return sft(spark, d).select("conv_id", M.chars_by_role(m, "user").alias("user_chars"),
                                M.chars_by_role(m, "assistant").alias("assistant_chars"))


@query("first_message", f"""WITH {CHAT}
SELECT conv_id, coalesce(arg_min(content, turn) FILTER (role = 'user'), '') AS first_user,
  coalesce(arg_min(content, turn) FILTER (role = 'assistant'), '') AS first_assistant FROM chat GROUP BY conv_id""")
def first_message(spark, d):
    m = F.col("messages")
    return sft(spark, d).select("conv_id", M.first_message(m, "user").alias("first_user"),
                                M.first_message(m, "assistant").alias("first_assistant"))


@query("conversation_stats", f"""WITH {CHAT}
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS assistant_turns,
  CAST(coalesce(sum(length(content)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars,
  CAST(coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_chars,
  coalesce(arg_min(content, turn) FILTER (role = 'user'), '') AS first_user,
  coalesce(arg_min(content, turn) FILTER (role = 'assistant'), '') AS first_assistant FROM chat GROUP BY conv_id""")
def conversation_stats(spark, d):
    return P.conversation_stats(chat(spark, d), "conv_id")


@query("last_assistant", f"WITH {EXTRACT} SELECT conv_id, a AS content FROM split")
def last_assistant(spark, d):
    return E.last_assistant_rows(chat(spark, d), "conv_id")


@query("last_user_before", f"WITH {EXTRACT} SELECT conv_id, last_user FROM prompts")
def last_user_before(spark, d):
    rows = sft(spark, d).where(M.last_assistant(F.col("messages")).isNotNull())
    return rows.select("conv_id", M.last_user_before(F.col("messages")).alias("last_user"))


@query("prior_context", f"WITH {EXTRACT} SELECT conv_id, context FROM prompts")
def prior_context(spark, d):
    rows = sft(spark, d).where(M.last_assistant(F.col("messages")).isNotNull())
    return rows.select("conv_id", M.prior_context(F.col("messages")).alias("context"))


@query("message_text_union", f"""WITH {CHAT}
SELECT conv_id, string_agg(content, chr(10) ORDER BY turn) AS prompt,
  coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS chosen FROM chat GROUP BY conv_id
UNION ALL SELECT -1 - doc_id, text, '' FROM documents""")
def message_text_union(spark, d):
    m = F.col("messages")
    lists = sft(spark, d).select("conv_id", "messages")
    strings = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("conv_id"),
                                                  M.as_messages(F.col("text")).alias("messages"))
    return lists.unionByName(strings).select(
        "conv_id", M.message_text_union(m, limit=None).alias("prompt"),
        M.message_text_union(m, "assistant").alias("chosen"))


RECORD = """CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS id, conv_id, source AS dataset_source"""


@query("extract_two_part", f"""WITH {EXTRACT}
SELECT {RECORD}, last_user AS user_prompt, think_text, response_text FROM split JOIN prompts USING (conv_id)""")
def extract_two_part(spark, d):
    return E.extract_two_part(sft(spark, d), "conv_id")


@query("extract_combined", f"""WITH {EXTRACT}
SELECT {RECORD}, context AS user_prompt, think_text, response_text, num_turns FROM split JOIN prompts USING (conv_id)""")
def extract_combined(spark, d):
    return E.extract_combined(sft(spark, d), "conv_id")


@query("extract_for_scoring", f"""WITH {EXTRACT}
SELECT conv_id, source, think_text, response_text FROM split WHERE think_text <> '' OR response_text <> ''""")
def extract_for_scoring(spark, d):
    return E.extract_for_scoring(sft(spark, d), "conv_id")


# A token is a run of non-space characters here; the limit leaves some texts over it.
def _tokens(c):
    return F.size(F.regexp_extract_all(c, F.lit(r"[^ \n]+"), F.lit(0)))


GATED = f"""{EXTRACT},
joined AS (SELECT conv_id, source, context AS user_prompt, think_text, response_text, num_turns,
  {rust_strip("context || chr(10) || chr(10) || think_text || chr(10) || chr(10) || response_text")} AS t
  FROM split JOIN prompts USING (conv_id)),
counted AS (SELECT *, CAST(len(regexp_extract_all(t, '[^ \\n]+')) AS BIGINT) AS tokens FROM joined)"""


def _gate(spark, d):
    records = materialise(E.extract_combined(sft(spark, d), "conv_id", dense_ids=False), "extracted")
    return E.length_gate(records, "conv_id", _tokens, max_length=200)


@query("filter_by_length", f"""WITH {GATED}
SELECT CAST(row_number() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS id, conv_id, source AS dataset_source, user_prompt, think_text,
  response_text, num_turns FROM counted WHERE length(t) > 0 AND coalesce(tokens, 0) <= 198""")
def filter_by_length(spark, d):
    return E.renumber(_gate(spark, d)[0], "conv_id")


@query("length_gate", f"""WITH {GATED}
SELECT conv_id AS id, source AS dataset_source, CASE WHEN length(t) = 0 THEN 'empty' ELSE 'too_long' END AS reason,
  CASE WHEN length(t) = 0 THEN 0 ELSE tokens END AS token_count
FROM counted WHERE length(t) = 0 OR coalesce(tokens, 0) > 198""")
def length_gate(spark, d):
    return _gate(spark, d)[1]


@query("drop_reason_counts", f"""WITH {GATED}
SELECT CASE WHEN length(t) = 0 THEN 'empty' ELSE 'too_long' END AS reason, CAST(count(*) AS BIGINT) AS "count"
FROM counted WHERE length(t) = 0 OR coalesce(tokens, 0) > 198 GROUP BY 1""")
def drop_reason_counts(spark, d):
    return E.drop_reason_counts(_gate(spark, d)[1])


@query("token_length", """
SELECT conv_id, turn, least(CAST(len(regexp_extract_all(text, '[^ \\n]+')) AS BIGINT), 40) AS tokens FROM conversations""")
def token_length(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", E.truncated_length(_tokens(F.col("text")), 40).cast("bigint").alias("tokens"))


@query("token_count_mask", """
SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^ \\n]+'))) AS BIGINT) AS tokens,
  CAST(coalesce(sum(len(regexp_extract_all(text, '[^ \\n]+'))) FILTER (role = 'assistant'), 0) AS BIGINT) AS trainable_tokens
FROM conversations GROUP BY conv_id""")
def token_count_mask(spark, d):
    rows = table(spark, d, "conversations").withColumnRenamed("text", "content")
    return E.trainable_tokens(rows, "conv_id", _tokens)


@query("resume_skip", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_skip(spark, d):
    return E.resume_skip(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("drop_empty_both", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND text <> ''")
def drop_empty_both(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("<think> </think> ")).otherwise(F.col("text"))
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    rows = table(spark, d, "documents").select("doc_id", "source", F.array(message).alias("messages"))
    return E.extract_for_scoring(rows, "doc_id").select("doc_id")


@query("documents_from_conversations", """
SELECT conv_id, 'src' || (conv_id % 16) AS source, least(CAST(sum(len(regexp_extract_all(text, '[^ \\n]+'))) AS BIGINT), 500) AS token_count
FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')""")
def documents_from_conversations(spark, d):
    def words(messages):
        return F.aggregate(messages, F.lit(0), lambda n, m: n + _tokens(m["content"]))

    rows = plain_messages(spark, d).groupBy("conv_id", "source").agg(
        F.collect_list(F.struct("role", "content")).alias("messages"))
    return L.documents_from_conversations(rows, "conv_id", "source", words, 500)


@query("assistant_report", """WITH c AS (SELECT bool_or(role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT CAST(count(*) AS BIGINT) AS conversations, CAST(count(*) FILTER (a) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT a) AS BIGINT) AS removed FROM c""")
def assistant_report(spark, d):
    return L.assistant_report(sft(spark, d))
