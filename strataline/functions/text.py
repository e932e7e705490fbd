"""Column functions over single strings: think tags, names, previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# The code points Unicode calls White_Space, and the four separators that Python's
# str.strip() removes as well.
UNICODE_SPACE = "".join(
    map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PYTHON_SPACE = UNICODE_SPACE + "\x1c\x1d\x1e\x1f"

# Fixed patterns: a uuid tail, a seven-character tail, a numeric tail, applied in this order.
# \z, not $: the tail must end at the very end of the text, not before a last newline.
ID_SUFFIXES = [
    r"_[a-f0-9]{8}-[a-f0-9-]+.*\z",
    r"_[a-z0-9]{7}\z",
    r"_\d+\z",
]


def strip(c: Column, chars: str = PYTHON_SPACE) -> Column:
    """Trim all Unicode white space from both ends (``trim`` alone knows only the space)."""
    return F.trim(c, F.lit(chars))


def content_length(c: Column) -> Column:
    return F.length(c).cast("bigint")


def dataset_name_from_id(c: Column) -> Column:
    for pattern in ID_SUFFIXES:
        c = F.regexp_replace(c, pattern, "")
    return c


def has_think_tags(c: Column) -> Column:
    return c.contains(THINK_OPEN) & c.contains(THINK_CLOSE)


def _after(c: Column, position: Column) -> Column:
    return c.substr(position, F.length(c))


def split_think(c: Column) -> Column:
    """struct(think, response); both tags are needed, and text before the first tag is lost."""
    start = F.instr(c, THINK_OPEN) + len(THINK_OPEN)
    end = F.instr(c, THINK_CLOSE)
    tagged = has_think_tags(c)
    think = F.when(tagged & (end >= start), strip(c.substr(start, end - start)))
    response = F.when(tagged, strip(_after(c, end + len(THINK_CLOSE))))
    return F.struct(
        F.when(c.isNotNull(), F.coalesce(think, F.lit(""))).alias("think"),
        F.coalesce(response, c).alias("response"),
    )


def split_think_lengths(c: Column) -> Column:
    """struct(think_block_len, response_len); the response ends at a second closing tag."""
    block = F.split_part(c, F.lit(THINK_CLOSE), F.lit(1))
    rest = F.split_part(c, F.lit(THINK_CLOSE), F.lit(2))
    return F.struct(
        (content_length(block) + len(THINK_CLOSE)).alias("think_block_len"),
        content_length(strip(rest, UNICODE_SPACE)).alias("response_len"),
    )


def split_think_block(c: Column) -> Column:
    """struct(think_block, response): everything through the first closing tag, and the rest."""
    cut = F.instr(c, THINK_CLOSE) + len(THINK_CLOSE) - 1
    return F.when(
        has_think_tags(c),
        F.struct(c.substr(F.lit(1), cut).alias("think_block"),
                 strip(_after(c, cut + 1)).alias("response")),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("think_block"), c.alias("response")))


def split_think_parts(c: Column) -> Column:
    """struct(before, think, answer); empty parts are null, the think part keeps its spaces."""
    start = F.instr(c, THINK_OPEN)
    inner = start + len(THINK_OPEN)
    end = F.instr(c, THINK_CLOSE)
    tagged = has_think_tags(c)
    before = F.when(tagged, strip(c.substr(F.lit(1), start - 1)))
    think = F.when(tagged & (end >= inner), c.substr(inner, end - inner))
    answer = F.when(tagged, strip(_after(c, end + len(THINK_CLOSE)))).otherwise(c)
    return F.struct(
        F.when(before != "", before).alias("before"),
        F.when(think != "", think).alias("think"),
        F.when(answer != "", answer).alias("answer"),
    )


def extract_answer(c: Column) -> Column:
    """Text after the first closing tag, or the whole text, stripped."""
    end = F.instr(c, THINK_CLOSE)
    return strip(F.when(end > 0, _after(c, end + len(THINK_CLOSE))).otherwise(c))


def extract_think(c: Column) -> Column:
    """The first complete think block, stripped; empty when there is none."""
    return strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


def strip_special_token(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)<\|[^>]+\|>\s*$", "")


def clean_response(c: Column) -> Column:
    """Remove every think block and one trailing special token."""
    return strip(strip_special_token(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")))


def format_output(c: Column) -> Column:
    """Chat display: a ``[Think]`` section before the answer when there is a think block."""
    text = strip(strip_special_token(c))
    think = extract_think(text)
    found = F.regexp_like(text, F.lit(r"(?s)<think>.*?</think>"))
    answer = strip(F.regexp_replace(text, r"(?s)^.*?<think>.*?</think>", ""))
    titled = F.when(think != "", F.concat(F.lit("[Think]\n"), think))
    return F.when(found, F.concat_ws("\n\n", titled, answer)).otherwise(text)


def concat_record_text(prompt: Column, think: Column, response: Column) -> Column:
    """The embedding input. Empty parts keep their separators until the final strip."""
    gap = F.lit("\n\n")
    return strip(F.concat(prompt, gap, think, gap, response), UNICODE_SPACE)


def placeholder_empty(c: Column, placeholder: str = "[empty]") -> Column:
    return F.when(c == "", F.lit(placeholder)).otherwise(c)


def preview_text(c: Column, size: int, one_line: bool = False) -> Column:
    head = c.substr(1, size)
    if one_line:
        head = F.replace(head, F.lit("\n"), F.lit(" "))
    return F.when(F.length(c) > size, F.concat(head, F.lit("..."))).otherwise(head)


def shorten_source(c: Column, owner: str = "", limit: int = 30, keep: int = 27) -> Column:
    """Drop the owner prefix, show underscores as spaces and shorten names over the limit."""
    name = F.replace(c, F.lit(owner), F.lit("")) if owner else c
    name = F.replace(name, F.lit("_"), F.lit(" "))
    return F.when(F.length(name) > limit, F.concat(name.substr(1, keep), F.lit("..."))).otherwise(name)


def safe_name(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def metric_prefix(c: Column) -> Column:
    return F.when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1))).otherwise("(top-level)")


def metric_short_name(c: Column) -> Column:
    """Benchmark name of an accuracy metric, or the domain of a perplexity metric."""
    pieces = F.split(c, "/")
    accuracy = F.replace(F.replace(c, F.lit("eval/downstream/"), F.lit("")), F.lit(" (accuracy)"), F.lit(""))
    perplexity = F.when(F.size(pieces) >= 4, F.get(pieces, F.lit(2))).otherwise(c)
    return F.when(c.contains("(accuracy)"), accuracy).when(c.endswith("/PPL"), perplexity).otherwise(c)


def name_pattern(c: Column) -> Column:
    return F.substring_index(c, "-", 2)


def tag_key(tags: Column) -> Column:
    joined = F.array_join(tags, ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("(no tags)")).otherwise(joined)


def html_escape(c: Column, single_quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    if single_quotes:
        pairs.append(("'", "&#x27;"))
    for char, entity in pairs:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def parse_json_or_keep(c: Column) -> Column:
    """A variant: the parsed value when the string is JSON, else the string itself."""
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))


def contains_any(c: Column, words: list[str]) -> Column:
    """Case-insensitive literal substring test against any of the words."""
    lowered = F.lower(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word.lower())
    return hit


def mentions(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
