"""Search and selection inside nested run configurations (JSON text or variant)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as C, text as X


def config_leaves(configs: DataFrame, key: str, config: str, max_depth: int = 100) -> DataFrame:
    """(key, path, value) of every string in a nested configuration, paths like ``a.b[0]``.

    Where the root is a list paths begin with ``[0]``; a root that is a string has an empty path.
    Sections that are themselves JSON text are parsed, as the first level only. The walk is a
    recursive query over variant pieces, one level of all configurations at a time; it stops with an
    error, never silently, when a configuration is nested deeper than ``max_depth``.
    """
    spark = configs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    roots = (configs.select(F.col(key).alias("run"), X.parse_json_or_keep(F.col(config)).alias("value")))
    view = f"_config_roots_{uuid.uuid4().hex}"
    roots.createOrReplaceTempView(view)
    sections = f"""
        SELECT r.run, coalesce(s.key, concat('[', s.pos, ']')) AS path,
               CASE WHEN s.key IS NOT NULL AND schema_of_variant(s.value) = 'STRING'
                    THEN coalesce(try_parse_json(try_variant_get(s.value, '$', 'string')), s.value)
                    ELSE s.value END AS value
        FROM {view} r, LATERAL variant_explode(r.value) s
        UNION ALL SELECT run, '' AS path, value FROM {view} WHERE schema_of_variant(value) = 'STRING'"""
    walked = spark.sql(f"""
        WITH RECURSIVE walk(run, path, value) MAX RECURSION LEVEL {int(max_depth)} AS (
            SELECT * FROM ({sections})
            UNION ALL
            SELECT w.run,
                   CASE WHEN e.key IS NULL THEN concat(w.path, '[', e.pos, ']')
                        ELSE concat(w.path, '.', e.key) END,
                   e.value
            FROM walk w, LATERAL variant_explode(w.value) e
        )
        SELECT run, path, try_variant_get(value, '$', 'string') AS value FROM walk
        WHERE schema_of_variant(value) = 'STRING'""")
    spark.catalog.dropTempView(view)
    return walked.withColumnRenamed("run", key)


def config_references(configs: DataFrame, key: str, config: str,
                      extra_patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """(key, path, label, match) for everything that looks like a data reference."""
    leaves = config_leaves(configs, key, config)
    return (leaves.select(key, "path", F.explode(C.reference_matches(F.col("value"), extra_patterns)).alias("r"))
            .select(key, "path", "r.label", "r.match"))


def find_run(runs: DataFrame, name: str, pattern: str, order_by: str) -> DataFrame:
    """The first run whose name matches."""
    return runs.where(F.col(name).rlike(pattern)).orderBy(order_by).limit(1)


def config_section(configs: DataFrame, key: str, config: str, section: str) -> DataFrame:
    """One section of each configuration as JSON text, or ``(not present)``."""
    value = F.try_variant_get(X.parse_json_or_keep(F.col(config)), f"$.{section}", "variant")
    as_text = F.try_variant_get(X.parse_json_or_keep(F.col(config)), f"$.{section}", "string")
    parsed = F.coalesce(F.to_json(F.try_parse_json(as_text)), as_text, F.to_json(value))
    return configs.select(key, F.coalesce(parsed, F.lit("(not present)")).alias("section"))


def config_entries(configs: DataFrame, key: str, config: str) -> DataFrame:
    """(key, name, value, type) of the top level of each configuration; values as text."""
    roots = configs.select(key, X.parse_json_or_keep(F.col(config)).alias("_root"))
    pieces = roots.lateralJoin(
        roots.sparkSession.tvf.variant_explode(F.col("_root").outer()))
    return pieces.select(key, F.col("key").alias("name"),
                         F.coalesce(F.try_variant_get(F.col("value"), "$", "string"), F.to_json("value")).alias("value"),
                         F.schema_of_variant("value").alias("type"))


def interesting_config(configs: DataFrame, key: str, config: str, names: list[str], words: list[str],
                       width: int = 120) -> DataFrame:
    """Top-level entries with one of the names, or with a name that contains a word; long values cut."""
    entries = config_entries(configs, key, config)
    return (entries.where(F.col("name").isin(names) | X.contains_any(F.col("name"), words))
            .select(key, "name", X.preview_text(F.col("value"), width).alias("value")))


def summary_values(summaries: DataFrame, key: str, summary: str, words: list[str]) -> DataFrame:
    """Numeric summary entries whose name contains a word."""
    entries = config_entries(summaries, key, summary)
    numeric = F.col("type").isin("BIGINT", "DOUBLE", "BOOLEAN") | F.col("type").startswith("DECIMAL")
    return (entries.where(X.contains_any(F.col("name"), words) & numeric)
            .select(key, "name", F.when(F.col("type") == "BOOLEAN", F.col("value").try_cast("boolean").cast("double"))
                    .otherwise(F.col("value").try_cast("double")).alias("value")))
