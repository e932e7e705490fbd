"""Embeddings and their analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as D, vectors as V
from .registry import query
from .tables import VECTORS, pca_model, rounded, sql_rounded, table, vectors


@query("attach_vectors", f"""WITH {VECTORS}
SELECT v.id, v.source, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first FROM vectors v JOIN documents d ON d.doc_id = v.id""")
def attach_vectors(spark, d):
    metadata = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return D.attach_vectors(metadata, vectors(spark, d)).select(
        "id", "source", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("embed_texts", """
SELECT doc_id, CAST(256 AS BIGINT) AS width, CAST(1.0 AS DOUBLE) AS norm FROM documents""")
def embed_texts(spark, d):
    out = D.embed_texts(table(spark, d, "documents"), "doc_id", "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("doc_id", F.size("embedding").cast("bigint").alias("width"), F.round(norm, 4).alias("norm"))


def _flat(model):
    """Directions as rows, so that the result has no arrays."""
    return model.select("grp", "pc", "n_rows", F.round("explained_ratio", 9).alias("ratio"),
                        F.posexplode("component").alias("dim", "loading")).select(
        "grp", "pc", "n_rows", "ratio", F.col("dim").cast("bigint").alias("dim"), rounded("loading").alias("loading"))


WHOLE = f"WITH RECURSIVE {VECTORS}, " + pca_model("'_all'", 10, 1, 0)
BY_SOURCE = f"WITH RECURSIVE {VECTORS}, " + pca_model("source", 10, 3, 1)
DIRECTIONS = f""", loadings AS (SELECT grp, pc, n_rows, round(ratio, 9) AS ratio,
  CAST(generate_subscripts(component, 1) - 1 AS BIGINT) AS dim, unnest(component) AS loading FROM model)
SELECT grp, pc, n_rows, ratio, dim, {sql_rounded("loading")} AS loading FROM loadings"""


@query("pca_fit", WHOLE + DIRECTIONS)
def pca_fit(spark, d):
    return _flat(V.pca_fit(vectors(spark, d), "embedding", 10))


@query("pca_by_source", BY_SOURCE + DIRECTIONS)
def pca_by_source(spark, d):
    return _flat(V.pca_by_source(vectors(spark, d), "embedding", "source", 10))


# All directions together explain the total variance, which SQL can sum per dimension.
@query("pca_total_variance", f"""WITH {VECTORS},
x AS (SELECT source, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM vectors),
p AS (SELECT source, dim, var_samp(v) AS var, count(*) AS n FROM x GROUP BY source, dim HAVING count(*) >= 3)
SELECT source, CAST(max(n) AS BIGINT) AS n_rows, round(sum(var), 8) AS total_variance, CAST(1.0 AS DOUBLE) AS explained FROM p GROUP BY source""")
def pca_total_variance(spark, d):
    model = V.pca_by_source(vectors(spark, d), "embedding", "source", 64)
    return model.groupBy(F.col("grp").alias("source")).agg(
        F.max("n_rows").alias("n_rows"), F.round(F.sum("explained_variance"), 8).alias("total_variance"),
        F.round(F.sum("explained_ratio"), 6).alias("explained"))


@query("pca_project", WHOLE + f" SELECT id, grp, pc, {sql_rounded('score')} AS score FROM scores WHERE pc <= 3")
def pca_project(spark, d):
    rows = vectors(spark, d)
    scores = V.pca_project(rows, V.pca_fit(rows, "embedding", 3), "id", "embedding")
    return scores.withColumn("score", rounded("score"))


@query("pca_project_by_source", BY_SOURCE + f" SELECT id, grp, pc, {sql_rounded('score')} AS score FROM scores WHERE pc <= 2")
def pca_project_by_source(spark, d):
    rows = vectors(spark, d)
    model = V.pca_by_source(rows, "embedding", "source", 2)
    return V.pca_project(rows, model, "id", "embedding", "source").withColumn("score", rounded("score"))


# Scores are centred, uncorrelated between directions, and their variance is the explained one.
@query("pca_scores_check", f"""WITH {VECTORS}
SELECT CAST(pc AS BIGINT) AS pc, CAST(count(*) AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean_score, CAST(1 AS DOUBLE) AS variance_ratio
FROM vectors, range(1, 4) t(pc) GROUP BY pc""")
def pca_scores_check(spark, d):
    rows = vectors(spark, d)
    model = V.pca_fit(rows, "embedding", 3)
    scores = V.pca_project(rows, model, "id", "embedding")
    stats = scores.groupBy("pc").agg(F.count("*").alias("n"), rounded(F.avg("score"), 8).alias("mean_score"),
                                     F.var_samp("score").alias("var"))
    return stats.join(model.select("pc", "explained_variance"), "pc").select(
        "pc", "n", "mean_score", F.round(F.col("var") / F.col("explained_variance"), 6).alias("variance_ratio"))


@query("pc1_ranking", BY_SOURCE + " SELECT grp AS source, round(100 * ratio, 7) AS pc1_pct FROM model WHERE pc = 1")
def pc1_ranking(spark, d):
    ranking = V.pc1_ranking(V.pca_by_source(vectors(spark, d), "embedding", "source"))
    return ranking.withColumn("pc1_pct", F.round("pc1_pct", 7))


@query("scree_table", WHOLE + """ SELECT grp, pc, round(100 * ratio, 7) AS pct,
  round(100 * sum(ratio) OVER (ORDER BY pc), 7) AS cumulative_pct FROM model""")
def scree_table(spark, d):
    out = V.scree_table(V.pca_fit(vectors(spark, d), "embedding", 10))
    return out.select("grp", "pc", F.round("pct", 7).alias("pct"), F.round("cumulative_pct", 7).alias("cumulative_pct"))


@query("cumulative_ratio", f"""WITH {VECTORS}
SELECT source, CAST(100.0 AS DOUBLE) AS cumulative_pct FROM vectors GROUP BY source HAVING count(*) >= 3""")
def cumulative_ratio(spark, d):
    model = V.pca_by_source(vectors(spark, d), "embedding", "source", 64)
    return V.scree_table(model).groupBy(F.col("grp").alias("source")).agg(
        F.round(F.max("cumulative_pct"), 6).alias("cumulative_pct"))


@query("pc_extremes", WHOLE + f""",
ranked AS (SELECT s.*, v.source, row_number() OVER (PARTITION BY pc ORDER BY score DESC, id) AS hi,
  row_number() OVER (PARTITION BY pc ORDER BY score, id) AS lo FROM scores s JOIN vectors v USING (id) WHERE pc <= 5)
SELECT pc, 'positive' AS direction, CAST(hi AS BIGINT) AS rank, {sql_rounded('score')} AS score, id, source FROM ranked WHERE hi <= 5
UNION ALL SELECT pc, 'negative', CAST(lo AS BIGINT), {sql_rounded('score')}, id, source FROM ranked WHERE lo <= 5""")
def pc_extremes(spark, d):
    rows = vectors(spark, d)
    scores = V.pca_project(rows, V.pca_fit(rows, "embedding", 5), "id", "embedding")
    out = V.pc_extremes(scores, rows.select("id", "source"), "id", 5)
    return out.select("pc", "direction", F.col("rank").cast("bigint").alias("rank"), rounded("score").alias("score"),
                      "id", "source")


# The same selection on a coordinate instead of a fitted score.
@query("pc_extremes_by_coordinate", f"""WITH {VECTORS},
s AS (SELECT id, source, source AS grp, CAST(embedding[1] AS DOUBLE) AS score FROM vectors),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS hi, row_number() OVER (PARTITION BY grp ORDER BY score, id) AS lo FROM s)
SELECT grp, 'positive' AS direction, CAST(hi AS BIGINT) AS rank, round(score, 6) AS score, id, source FROM r WHERE hi <= 2
UNION ALL SELECT grp, 'negative', CAST(lo AS BIGINT), round(score, 6), id, source FROM r WHERE lo <= 2""")
def pc_extremes_by_coordinate(spark, d):
    rows = vectors(spark, d)
    scores = rows.select("id", F.col("source").alias("grp"), F.lit(1).cast("bigint").alias("pc"),
                         F.col("embedding")[0].cast("double").alias("score"))
    return V.pc_extremes(scores, rows.select("id", "source"), "id", 2).select(
        "grp", "direction", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"), "id", "source")


@query("direction_similarity", BY_SOURCE + """,
k AS (SELECT grp || ' PC' || pc AS label, component AS v FROM model WHERE pc <= 2)
SELECT a.label AS label_a, b.label AS label_b, """ + sql_rounded("list_cosine_similarity(a.v, b.v)") + """ AS cosine FROM k a CROSS JOIN k b""")
def direction_similarity(spark, d):
    model = V.pca_by_source(vectors(spark, d), "embedding", "source", 2)
    return V.direction_similarity(model).select("label_a", "label_b", rounded("cosine").alias("cosine"))


# Directions taken from the table itself: the first two vectors of each source.
@query("direction_similarity_of_rows", f"""WITH {VECTORS},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS pc FROM vectors),
k AS (SELECT source, pc, source || ' PC' || pc AS label, embedding::DOUBLE[] AS v FROM r WHERE pc <= 2)
SELECT a.label AS label_a, b.label AS label_b, {sql_rounded("list_cosine_similarity(a.v, b.v)", 6)} AS cosine FROM k a CROSS JOIN k b""")
def direction_similarity_of_rows(spark, d):
    from ..operators.sampling import top_per_group

    first = top_per_group(vectors(spark, d), ["source"], [F.col("id")], 2, "pc")
    model = first.select(F.col("source").alias("grp"), "pc", F.col("embedding").alias("component"))
    return V.direction_similarity(model).select("label_a", "label_b", rounded("cosine", 6).alias("cosine"))


POINTS = f""" SELECT s.id, max(v.source) AS source, {sql_rounded("max(score) FILTER (pc = 1)")} AS x,
  {sql_rounded("max(score) FILTER (pc = 2)")} AS y"""


@query("scatter_points", WHOLE + POINTS + """, CAST(dense_rank() OVER (ORDER BY max(v.source)) - 1 AS BIGINT) AS colour
FROM scores s JOIN vectors v USING (id) GROUP BY s.id""")
def scatter_points(spark, d):
    out = V.scatter_points(vectors(spark, d), "id", "embedding", "source")
    return out.select("id", "source", rounded("x").alias("x"), rounded("y").alias("y"),
                      F.col("colour").cast("bigint").alias("colour"))


@query("think_vs_response", f"WITH RECURSIVE {VECTORS}, "
       + pca_model("CASE WHEN id % 2 = 0 THEN 'think' ELSE 'response' END", 2, 1, 0) + POINTS + """, s.grp AS text_type
FROM scores s JOIN vectors v USING (id) GROUP BY s.id, s.grp""")
def think_vs_response(spark, d):
    rows = vectors(spark, d).withColumn("text_type", F.when(F.col("id") % 2 == 0, "think").otherwise("response"))
    out = V.think_vs_response(rows, "id", "embedding", "source", "text_type")
    return out.select("id", "source", rounded("x").alias("x"), rounded("y").alias("y"), "text_type")


@query("knn_graph", f"""WITH {VECTORS}, v AS (SELECT id, embedding::DOUBLE[] AS e FROM vectors),
pairs AS (SELECT a.id, b.id AS neighbor_id, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT id, CAST(rank AS BIGINT) AS rank, neighbor_id, {sql_rounded("distance", 6)} AS distance FROM r WHERE rank <= 15""")
def knn_graph(spark, d):
    out = V.knn_graph(vectors(spark, d), "id", "embedding")
    return out.select("id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", rounded("distance", 6).alias("distance"))
