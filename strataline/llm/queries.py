"""The registered queries of these operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, packing, passages, prefix_trie, quality_rules, secrets, simhash, spelling, url_filter, versions, warc, weak_labels
from ..catalog.registry import query

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_CHAT_ESCAPED = r"""regexp_replace(replace(t.text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\]|NEXT\])', '\1\3\\\2\4', 'g')"""


@query("op1_chat_formatting", f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
               union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e as (select t.*, {_CHAT_ESCAPED} as escaped,
                 coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as goes_on from t)
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
           cast(sum(length(escaped) + case when goes_on then 6 else 20 + length(role) end) as bigint) as formatted_chars
    from e group by conv_id""")
def chat_formatting(spark, sf_dir):
    """All conversations and one that holds control strings, formatted and read back."""
    own = (spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat.format_chats(rows)
    read = chats.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"),
                        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op2_warc_normaliser")
def warc_normaliser(spark, sf_dir):
    """Every page as a WARC record, read back from the normalised archives."""
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"), spark)
    records = warc.read_archives(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_secret_scan")
def secret_scan(spark, sf_dir):
    """Counts, digest and places of the secrets in every document."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = secrets.spans_text(F.filter(spans, lambda s: s["kind"] < 3))
    counts = [F.size(F.filter(spans, lambda s, k=k: s["kind"] == k)).cast("bigint").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


@query("op4_repeated_passages")
def repeated_passages(spark, sf_dir):
    """Passages of 50 words and more that documents share."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    """Benchmark items found in documents, within the error budget."""
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    """Fingerprint and group of every document."""
    groups = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_CANONICAL = r"""case when host <> '' then regexp_replace(host, '^www\.|:(80|443)$', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') end"""


@query("op8_url_filter", f"""
    with parts as (select page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) as host,
                          regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
    keyed as (select *, {_CANONICAL} as key from parts),
    listed as (select key from keyed where key is not null group by key having count(*) > 1),
    ruled as (select k.*, l.key is not null as listed,
                     case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                          when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                          when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                          when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
              from keyed k left join listed l on k.key = l.key)
    select page_id, host, path, rule,
           case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                when listed then 'block' else 'allow' end as verdict, listed
    from ruled""")
def url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page, against the list of URLs that were crawled repeatedly."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.repeated_urls(pages))


@query("op9_quality_rules")
def quality_rule_verdicts(spark, sf_dir):
    """Counts, probabilities and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.train_heads(docs, table(spark, sf_dir, "labels")))


@query("op10_quality_classifier")
def weak_label_quality(spark, sf_dir):
    """Weak labels, probabilities and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    words = weak_labels.abuse_keywords(docs, table(spark, sf_dir, "labels"))
    return weak_labels.quality_classifier(docs, keywords=words)


@query("op11_conversation_prefix_trie")
def conversation_prefix_trie(spark, sf_dir):
    """Every distinct beginning of the rebuilt conversations, with what its subtree holds."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants")
def spelling_variant_grouping(spark, sf_dir):
    """Every word of the documents with the spelling that it is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and its edited text, and their likeness."""
    return versions.document_versions(table(spark, sf_dir, "documents"))
