"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with listed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter for each listed URL, bits that a URL sets, and blocks (of 64 bits) at most. The last bounds
#: what is broadcast to 8 MB of words; a longer list makes a fuller filter, and the exact join still decides.
BITS_PER_URL, HASH_BITS, MAX_BLOCKS = 16, 5, 1 << 19


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical(url: Column) -> Column:
    """Host without ``www.``, and path without index pages and trailing slashes; the same for http and https. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    return F.when(host != "", F.concat(host, path))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (verdict, host, path) that fits; null if none does.

    A rule fits its host and its subdomains if the path starts with the rule's. Rules are a short parameter, written
    into the plan; equally long ones go by their text.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """The bits that a key sets in its block, from one hash of its own."""
    second = F.xxhash64(F.lit("bits"), key)
    out = None
    for i in range(HASH_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom_filter(listed: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """(block, word): at most ``blocks`` rows of 64 bits, merged map-side."""
    return (listed.select(_block(F.col(key_col), blocks).alias("block"), _bits(F.col(key_col)).alias("bits"))
            .groupBy("block").agg(F.bit_or("bits").alias("word")))


def listed_urls(urls: DataFrame, listed: DataFrame, key_col: str = "key") -> DataFrame:
    """The distinct keys of ``urls`` that are in ``listed``: the filter passes possible ones, the join removes the rest.

    Only the filter is broadcast (see MAX_BLOCKS); both sides of the exact join are shuffled by key.
    """
    count = listed.count()
    blocks = min(MAX_BLOCKS, 1 << max(4, (count * BITS_PER_URL // 64).bit_length()))
    words = F.broadcast(bloom_filter(listed, key_col, blocks))
    keys = urls.select(key_col).filter(F.col(key_col).isNotNull())
    asked = keys.withColumn("_block", _block(F.col(key_col), blocks)).withColumn("_bits", _bits(F.col(key_col)))
    possible = asked.join(words, (F.col("_block") == F.col("block")) & (F.col("word").bitwiseAND(F.col("_bits")) == F.col("_bits")))
    return possible.select(key_col).distinct().join(listed.select(key_col).distinct(), key_col, "left_semi")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(``id_col``, host, path, rule, verdict, listed): one row per row of ``pages``.

    ``listed`` has a column ``key`` of canonical URLs; nulls and repeats in it do no harm. The longest rule that
    fits gives the verdict, else a listed URL is blocked and any other allowed. A null URL or one without ``://``
    has empty host and path and is never listed. Repeated rows each get theirs. Other columns are not looked at.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    hits = listed_urls(rows, listed.select("key").filter("key is not null"), "key").withColumn("listed", F.lit(True))
    judged = rows.join(hits, "key", "left").withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"),
                         F.coalesce("listed", F.lit(False)).alias("listed"))


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): canonical URLs that more than one row of ``pages`` has, as a list of pages crawled again and again."""
    keys = pages.select(canonical(F.col(url_col).cast("string")).alias("key")).filter("key is not null")
    return keys.groupBy("key").count().filter("count > 1").select("key")
