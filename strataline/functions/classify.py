"""First-match classification rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (needle, label), first match wins. The caller adds names of the model under test.
IDENTITY_RULES = [("deepseek", "DeepSeek"), ("qwen", "Qwen"), ("alibaba", "Alibaba"), ("openai", "OpenAI")]
GENERIC_IDENTITY = "Generic AI"

# First match wins; "rl" also hits words such as "world".
POSTTRAINING_RULES = [("sft", "SFT"), ("dpo", "DPO"), ("rl", "RL")]

# Right-open edges and labels of configuration sizes.
CONFIG_BUCKETS = [(0, 5, "0-4"), (5, 20, "5-19"), (20, 50, "20-49"), (50, 100, "50-99"),
                  (100, 500, "100-499"), (500, 10000, "500+")]

# Label and case-insensitive pattern of a data reference.
REFERENCE_PATTERNS = [
    ("HF URL", r"https?://huggingface\.co/\S+"),
    ("HF protocol URL", r"hf://\S+"),
    ("S3 path", r"s3://\S+"),
    ("GCS path", r"gs://\S+"),
    ("Weka path", r"weka://\S+"),
    ("Data path", r"/data/\S+"),
    ("Dataset path", r"/datasets?/\S+"),
    ("Data file extension", r"\.npy$|\.jsonl$|\.parquet$|\.arrow$|\.bin$|\.tar$"),
]


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    lowered = F.lower(c)
    chain = None
    for needle, label in rules:
        test = lowered.contains(needle)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def classify_identity(answer: Column, own_names: list[tuple[str, str]] = ()) -> Column:
    return first_match(answer, [*IDENTITY_RULES, *own_names], GENERIC_IDENTITY)


def classify_run(name: Column, stem: str) -> Column:
    """``stem`` is the fixed start of a timestamped base run, e.g. ``Model25``."""
    stamped = rf"^{stem}-\d{{8}}T\d{{6}}\+\d{{4}}$"
    return (F.when(name.startswith("anneal"), "annealing")
            .when(name.rlike(stamped), "pre-training")
            .otherwise("named-pre-training"))


def classify_posttraining(name: Column) -> Column:
    return first_match(name, POSTTRAINING_RULES, "other")


def config_bucket(count: Column) -> Column:
    """Null outside the edges, as those rows leave the report."""
    chain = None
    for low, high, label in CONFIG_BUCKETS:
        test = (count >= low) & (count < high)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def _labelled_matches(text: Column, label: str, pattern: str) -> Column:
    matches = F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0))
    return F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m.alias("match")))


def reference_matches(text: Column, extra: list[tuple[str, str]] = ()) -> Column:
    """array<struct<label, match>>: every match of every pattern in the text."""
    return F.concat(*[_labelled_matches(text, *rule) for rule in [*REFERENCE_PATTERNS, *extra]])
