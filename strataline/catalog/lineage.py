"""Packing, schedule, composition and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K, composition as C, packing as P, schedule as S
from ..plans.lineage import Lineage, LineageConfig, build_lineage
from .registry import query
from .tables import hash_key, table

SEQ, CHUNK, BATCH = 32_768, 500_000, 8
CONFIG = LineageConfig(sequence_length=SEQ, chunk_tokens=CHUNK, instances_per_batch=BATCH, epochs=2)
STEP_INTERVAL = 10


def lineage(spark, d) -> Lineage:
    return build_lineage(table(spark, d, "documents"), "doc_id", "source", "n_chars", CONFIG)


def chunked(spark, d):
    return P.assign_chunks(table(spark, d, "documents"), ["doc_id"], "n_chars", CHUNK)


def sized(spark, d):
    return P.effective_length(chunked(spark, d), "n_chars", CHUNK, SEQ)


# Each document's start is the previous document's end within the chunk, by lag.
SIZED = f"""ends AS (
  SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY {{order}}) - 1 AS position,
         sum(n_chars) OVER (ORDER BY {{order}}) AS c FROM documents),
chunks AS (SELECT *, (c - 1) // {CHUNK} AS chunk FROM ends WHERE c > 0),
starts AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY chunk ORDER BY position), chunk * {CHUNK}) AS st FROM chunks),
sized AS (SELECT *, least(c - st, {SEQ}) AS eff FROM starts WHERE c - st > 0)"""
BY_ID = SIZED.format(order="doc_id")
SHUFFLED = SIZED.format(order=hash_key("'42'", "doc_id") + ", doc_id")

# Best fit decreasing as a recursion, one document of every chunk per step. A bin is the number
# space * 1e9 + time of its last change, so the least value that fits is the tightest, oldest bin.
PACK = f"""ordered AS (SELECT chunk, position, eff, row_number() OVER (PARTITION BY chunk ORDER BY eff DESC, position) AS rn FROM sized),
pack AS (
  SELECT chunk, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS position, CAST(NULL AS BIGINT) AS bin, CAST([] AS BIGINT[]) AS bins
  FROM (SELECT DISTINCT chunk FROM sized)
  UNION ALL
  SELECT chunk, rn, position, CAST(coalesce(slot, len(bins) + 1) - 1 AS BIGINT),
    CASE WHEN slot IS NULL THEN list_append(bins, CAST(({SEQ} - eff) * 1000000000 + rn AS BIGINT))
      ELSE list_concat(list_append(bins[:slot - 1], CAST((bins[slot] // 1000000000 - eff) * 1000000000 + rn AS BIGINT)), bins[slot + 1:]) END
  FROM (SELECT o.chunk, o.rn, o.position, o.eff, p.bins,
          list_position(p.bins, list_min(list_filter(p.bins, lambda b: b >= o.eff * 1000000000))) AS slot
        FROM pack p JOIN ordered o ON o.chunk = p.chunk AND o.rn = p.rn + 1)),
firsts AS (SELECT chunk, sum(nb) OVER (ORDER BY chunk) - nb AS first_instance, nb
  FROM (SELECT chunk, max(bin) + 1 AS nb FROM pack GROUP BY chunk)),
packed AS (
  SELECT CAST(f.first_instance + p.bin AS BIGINT) AS instance_id, p.position,
    row_number() OVER (PARTITION BY p.chunk, p.bin ORDER BY p.rn) - 1 AS position_in_instance, p.chunk, s.eff AS effective_length, s.n_chars, s.source
  FROM pack p JOIN firsts f USING (chunk) JOIN sized s ON s.position = p.position),
counts AS (SELECT count(DISTINCT instance_id) AS n, count(DISTINCT instance_id) // {BATCH} AS spe FROM packed)"""

EPOCHS = f"""epochs AS (
  SELECT e.epoch, i.instance_id, row_number() OVER (PARTITION BY e.epoch
    ORDER BY {hash_key("CAST(34521 + e.epoch AS VARCHAR)", "i.instance_id")}, i.instance_id) - 1 AS rank
  FROM (SELECT DISTINCT instance_id FROM packed) i, (VALUES (1), (2)) e(epoch)),
steps AS (
  SELECT CAST((epoch - 1) * spe + rank // {BATCH} AS BIGINT) AS step, CAST(epoch AS BIGINT) AS epoch,
    CAST(rank % {BATCH} AS BIGINT) AS position_in_batch, instance_id FROM epochs, counts WHERE rank < spe * {BATCH}),
seen AS (SELECT s.step, s.instance_id, p.position AS doc_id, p.source AS source_dataset, p.n_chars AS token_count
  FROM steps s JOIN packed p USING (instance_id))"""

FULL = f"WITH RECURSIVE {SHUFFLED},\n{PACK},\n{EPOCHS}\n"


@query("assign_chunks", f"WITH {BY_ID} SELECT doc_id, n_chars, CAST(position AS BIGINT) AS position, CAST(c AS BIGINT) AS end_offset, CAST(chunk AS BIGINT) AS chunk FROM chunks")
def assign_chunks(spark, d):
    return chunked(spark, d)


@query("lag_end", f"WITH {BY_ID} SELECT doc_id, CAST(st AS BIGINT) AS start_in_chunk FROM starts WHERE c - st > 0")
def lag_end(spark, d):
    return sized(spark, d).select("doc_id", "start_in_chunk")


@query("effective_length", f"WITH {BY_ID} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(eff AS BIGINT) AS effective_length FROM sized")
def effective_length(spark, d):
    return sized(spark, d).select("doc_id", "chunk", "effective_length")


@query("dropped_tail_tokens", f"""WITH {BY_ID}
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS documents, CAST(max(c) AS BIGINT) AS last_end,
  CAST(least((chunk + 1) * {CHUNK}, (SELECT max(c) FROM ends)) - max(c) AS BIGINT) AS dropped_tail FROM chunks GROUP BY chunk""")
def dropped_tail_tokens(spark, d):
    return P.dropped_tail_tokens(chunked(spark, d), CHUNK)


@query("sorted_by_length", f"""WITH {BY_ID}
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(eff AS BIGINT) AS effective_length, CAST(count(*) AS BIGINT) AS docs FROM sized GROUP BY chunk, eff""")
def sorted_by_length(spark, d):
    return sized(spark, d).groupBy("chunk", "effective_length").agg(F.count("*").alias("docs"))


@query("pack_documents", f"""WITH RECURSIVE {BY_ID},
{PACK} SELECT instance_id, CAST(position AS BIGINT) AS position, CAST(position_in_instance AS BIGINT) AS position_in_instance,
  CAST(chunk AS BIGINT) AS chunk, CAST(effective_length AS BIGINT) AS effective_length FROM packed""")
def pack_documents(spark, d):
    return P.pack_documents(sized(spark, d), SEQ)


@query("packing_stats", f"""WITH RECURSIVE {BY_ID},
{PACK} SELECT CAST(n AS BIGINT) AS instances, CAST((SELECT count(*) FROM packed) AS BIGINT) AS documents,
  CAST(n * {SEQ} - (SELECT sum(effective_length) FROM packed) AS BIGINT) AS padding,
  CAST((SELECT sum(effective_length) FROM packed) AS BIGINT) AS packed_tokens, CAST(spe AS BIGINT) AS steps_per_epoch,
  CAST(spe * 2 AS BIGINT) AS total_steps, CAST(n - spe * {BATCH} AS BIGINT) AS dropped_per_epoch FROM counts""")
def packing_stats(spark, d):
    return P.packing_stats(P.packing_runs(sized(spark, d), SEQ), SEQ, BATCH, 2)


@query("instance_summary", FULL + """SELECT instance_id, CAST(count(*) AS BIGINT) AS num_documents,
  CAST(sum(n_chars) AS BIGINT) AS total_tokens, CAST(sum(effective_length) AS BIGINT) AS packed_tokens FROM packed GROUP BY instance_id""")
def instance_summary(spark, d):
    return lineage(spark, d).packed_instances


@query("document_boundaries", f"""WITH {BY_ID}
SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(chunk AS BIGINT) AS chunk,
  CAST(greatest(c - n_chars, chunk * {CHUNK}) - chunk * {CHUNK} AS BIGINT) AS "start", CAST(c - chunk * {CHUNK} AS BIGINT) AS "end" FROM chunks""")
def document_boundaries(spark, d):
    return P.document_boundaries(table(spark, d, "documents"), ["doc_id"], "n_chars", CHUNK)


@query("lineage_documents", f"""WITH {SHUFFLED}
SELECT CAST(position AS BIGINT) AS doc_id, CAST(doc_id AS VARCHAR) AS hf_id, source AS source_dataset, n_chars AS token_count FROM ends""")
def lineage_documents(spark, d):
    return lineage(spark, d).documents


@query("epoch_order", FULL + "SELECT CAST(epoch AS BIGINT) AS epoch, CAST(rank AS BIGINT) AS rank, instance_id FROM epochs")
def epoch_order(spark, d):
    docs = lineage(spark, d)
    return S.epoch_order(docs.packed_instances.select("instance_id"), 2)


@query("replay_epoch_order")
def replay_epoch_order(spark, d):
    return S.replay_epoch_order(P.instance_ids(P.packing_runs(sized(spark, d), SEQ)), 2)


@query("training_schedule", FULL + "SELECT step, epoch, position_in_batch, instance_id FROM steps")
def training_schedule(spark, d):
    return lineage(spark, d).training_steps


@query("step_epoch", FULL + """SELECT DISTINCT step, CAST(step // spe + 1 AS BIGINT) AS epoch, CAST(step % spe AS BIGINT) AS step_in_epoch FROM steps, counts""")
def step_epoch(spark, d):
    made = lineage(spark, d)
    spe = made.stats.select("steps_per_epoch").scalar()
    steps = made.training_steps.select("step").distinct().withColumn("s", S.step_epoch(F.col("step"), spe))
    return steps.select("step", "s.epoch", "s.step_in_epoch")


@query("rank_stripes", FULL + """SELECT step, position_in_batch, instance_id, CAST(position_in_batch % 4 AS BIGINT) AS dp_rank,
  CAST(position_in_batch // 4 AS BIGINT) AS dp_slot FROM steps""")
def rank_stripes(spark, d):
    return S.rank_stripes(lineage(spark, d).training_steps, 4).select(
        "step", "position_in_batch", "instance_id", "dp_rank", "dp_slot")


@query("resume_offset", FULL + "SELECT step, epoch, position_in_batch, instance_id FROM steps, counts WHERE epoch = 2 AND step >= spe + 3")
def resume_offset(spark, d):
    made = lineage(spark, d)
    return S.resume_offset(made.training_steps, 2, 3, made.stats.select("steps_per_epoch").scalar())


@query("step_range", FULL + "SELECT step, epoch, position_in_batch, instance_id FROM steps WHERE step >= 2 AND step < 5")
def step_range(spark, d):
    return S.step_range(lineage(spark, d).training_steps, 2, 5)


@query("lineage_join", FULL + "SELECT step, instance_id, CAST(doc_id AS BIGINT) AS doc_id, source_dataset, token_count FROM seen")
def lineage_join(spark, d):
    return lineage(spark, d).joined().select("step", "instance_id", "doc_id", "source_dataset", "token_count")


@query("steps_to_docs", FULL + "SELECT step, instance_id, CAST(doc_id AS BIGINT) AS doc_id, source_dataset, token_count FROM seen WHERE step >= 2 AND step < 5")
def steps_to_docs(spark, d):
    return C.steps_to_docs(lineage(spark, d).joined(), 2, 5)


@query("checkpoint_composition", FULL + f"""SELECT CAST(step // {STEP_INTERVAL} * {STEP_INTERVAL} AS BIGINT) AS step_start,
  CAST(least(step // {STEP_INTERVAL} * {STEP_INTERVAL} + {STEP_INTERVAL}, (SELECT spe * 2 FROM counts)) AS BIGINT) AS step_end, source_dataset,
  CAST(count(DISTINCT doc_id) AS BIGINT) AS num_documents, CAST(sum(token_count) AS BIGINT) AS total_tokens
FROM seen GROUP BY 1, 2, 3""")
def checkpoint_composition(spark, d):
    made = lineage(spark, d)
    return C.checkpoint_composition_of(made.training_steps, made.sources(), made.total_steps(), STEP_INTERVAL)


@query("step_composition", FULL + """SELECT source_dataset, CAST(count(*) AS BIGINT) AS "count" FROM seen WHERE step = 0 GROUP BY source_dataset""")
def step_composition(spark, d):
    return C.step_composition(lineage(spark, d).joined(), 0)


HALVES = """h AS (SELECT source_dataset, coalesce(sum(token_count) FILTER (step < (SELECT spe * 2 FROM counts) // 2), 0) AS a,
  coalesce(sum(token_count) FILTER (step >= (SELECT spe * 2 FROM counts) // 2), 0) AS b FROM seen GROUP BY source_dataset),
halves AS (SELECT source_dataset, CAST(a AS BIGINT) AS first_half, CAST(b AS BIGINT) AS second_half,
  CASE WHEN b > 0 THEN CAST(a AS DOUBLE) / CAST(b AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS ratio FROM h)"""


@query("half_composition", FULL + f", {HALVES} SELECT *, abs(ratio - 1.0) > 0.15 AS flagged FROM halves")
def half_composition(spark, d):
    made = lineage(spark, d)
    return C.half_composition_of(made.training_steps, made.sources(), made.total_steps())


@query("check_uniform", FULL + f", {HALVES} SELECT source_dataset, round(ratio, 9) AS ratio FROM halves WHERE abs(ratio - 1.0) > 0.15")
def check_uniform(spark, d):
    made = lineage(spark, d)
    halves = C.half_composition_of(made.training_steps, made.sources(), made.total_steps())
    return halves.where("flagged").select("source_dataset", F.round("ratio", 9).alias("ratio"))


@query("source_union", FULL + "SELECT DISTINCT source_dataset FROM seen")
def source_union(spark, d):
    made = lineage(spark, d)
    return C.sources_seen(made.training_steps, made.sources())


@query("check_range", FULL + """SELECT 'instances' AS measure, CAST(n AS BIGINT) AS value, n > 500000 AND n < 1000000 AS ok FROM counts
UNION ALL SELECT 'steps_per_epoch', CAST(spe AS BIGINT), spe > 15000 AND spe < 35000 FROM counts
UNION ALL SELECT 'total_steps', CAST(spe * 2 AS BIGINT), spe * 2 > 30000 AND spe * 2 < 70000 FROM counts""")
def check_range(spark, d):
    return K.check_range(lineage(spark, d).stats)


# The packer puts no document twice, so these two audits run on tables that have something to find.
@query("docs_in_many_instances", """
SELECT user_id AS doc_id, CAST(count(DISTINCT event_type) AS BIGINT) AS instances FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def docs_in_many_instances(spark, d):
    pairs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("instance_id"))
    return K.docs_in_many_instances(pairs)


@query("orphan_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_documents(spark, d):
    return K.orphan_documents(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"))


@query("check_one_instance", FULL + """SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS documents,
  CAST(count(DISTINCT position) AS BIGINT) AS packed, CAST((SELECT count(*) FROM documents) - count(DISTINCT position) AS BIGINT) AS orphans,
  CAST((SELECT count(*) FROM (SELECT position FROM packed GROUP BY position HAVING count(DISTINCT instance_id) > 1)) AS BIGINT) AS in_many_instances
FROM packed""")
def check_one_instance(spark, d):
    made = lineage(spark, d)
    return K.check_one_instance(made.documents, made.instance_documents)
