"""Verdicts on texts for the preparation of a dataset: reasoning, repetition, scripts, topics, dates and licences.

Each adds columns that say what was found, so that a filter on them drops rows and a count on them reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

THINK = ("<think>", "</think>")

# Scripts as Unicode names them.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul")

# Licence phrases, most specific first, with the name and verdict of each.
LICENCE_RULES = (
    (r"cc[ -]by[ -]nc|non-?commercial|attribution-noncommercial", "CC-BY-NC", "refused"),
    (r"no[ -]?derivatives|cc[ -]by[ -]nd", "CC-BY-ND", "refused"),
    (r"all rights reserved|proprietary", "proprietary", "refused"),
    (r"affero|\bagpl", "AGPL", "refused"),
    (r"lesser general public|\blgpl", "LGPL", "unclear"),
    (r"general public licen[sc]e|\bgpl", "GPL", "refused"),
    (r"mozilla public|\bmpl", "MPL", "unclear"),
    (r"apache", "Apache-2.0", "allowed"),
    (r"\bmit\b", "MIT", "allowed"),
    (r"\bbsd\b", "BSD", "allowed"),
    (r"cc0|public domain|unlicense", "CC0", "allowed"),
    (r"cc[ -]by[ -]sa", "CC-BY-SA", "unclear"),
    (r"cc[ -]by|creative commons attribution", "CC-BY", "allowed"),
)
_LICENCE_LINE = r"(?i)licen[sc]e|rights reserved|public domain|\bspdx\b"
_VERDICTS = ("refused", "unclear", "allowed")


def reasoning_state(text: Column, tags: tuple[str, str] = THINK) -> Column:
    """What became of a text's reasoning block, as struct<state, blocks, tail>.

    The tags are walked through in order of place. ``state`` is the first of these that holds: ``unopened`` (a closing tag
    without an open block), ``nested`` (an opening tag in an open block), ``unclosed`` (the text ends in an open block),
    ``none`` (no tags), ``unanswered`` (nothing but white space after the last block), ``cut_off`` (what follows it ends
    without a full stop, question or exclamation mark, closing bracket, quote or code fence), ``complete``. ``blocks`` counts
    closed blocks, ``tail`` the characters after the last tag. A null text has no tags.
    """
    opening, closing = tags
    whole = F.coalesce(text, F.lit(""))
    pattern = "|".join(r"\Q" + t + r"\E" for t in tags)
    found = F.regexp_extract_all(whole, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("unopened"), F.lit(False).alias("nested"), F.lit(0).cast("bigint").alias("blocks"))

    def step(at: Column, tag: Column) -> Column:
        opens = tag == opening
        return F.struct(F.when(opens, 1).otherwise(0).alias("depth"), (at["unopened"] | (~opens & (at["depth"] == 0))).alias("unopened"),
                        (at["nested"] | (opens & (at["depth"] == 1))).alias("nested"),
                        (at["blocks"] + F.when(~opens & (at["depth"] == 1), 1).otherwise(0)).alias("blocks"))

    tail = F.element_at(F.split(whole, pattern, -1), -1)
    ending = F.regexp_replace(tail, r"\s+$", "")

    def verdict(s: Column) -> Column:
        state = (F.when(s["unopened"], "unopened").when(s["nested"], "nested").when(s["depth"] == 1, "unclosed")
                 .when(s["blocks"] == 0, "none").when(ending == "", "unanswered")
                 .when(~ending.rlike(r"[.!?)\]\"'`}]$"), "cut_off").otherwise("complete"))
        return F.struct(state.alias("state"), s["blocks"].alias("blocks"), F.length(tail).cast("bigint").alias("tail"))

    return F.aggregate(found, start, step, verdict)


def incomplete_reasoning_filter(df: DataFrame, text: str, keep: tuple[str, ...] = ("none", "complete")) -> DataFrame:
    """``df`` with state, blocks, tail (see ``reasoning_state``) and ``kept``, whether the state is one of ``keep``."""
    judged = df.withColumn("_reasoning", reasoning_state(F.col(text)))
    return judged.select(*df.columns, "_reasoning.*").withColumn("kept", F.col("state").isin(*keep))


def _ranks(words):
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to the first length at which all differ."""
    import numpy as np

    levels = [words]
    span = 1
    while span < len(words) and levels[-1].max(initial=0) + 1 < len(words):
        rank = levels[-1].astype(np.int64) + 1
        after = np.zeros_like(rank)  # 0: beyond the end
        after[:-span] = rank[span:]
        _, dense = np.unique(rank * (len(words) + 2) + after, return_inverse=True)
        levels.append(dense.reshape(-1).astype(np.int32))
        span *= 2
    return levels


def _common(levels, i, j, n):
    """Length of the common beginning of suffixes i and j (arrays), by halving spans."""
    import numpy as np

    length = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # ranks of suffixes that are shorter than the span differ from all others, so equal ranks are equal words
        inside = (i + length < n) & (j + length < n)
        a, b = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
        whole = (a + (1 << level) <= n) & (b + (1 << level) <= n)
        length += np.where(inside & whole & (levels[level][a] == levels[level][b]), 1 << level, 0)
    return length


def _repetition(text: str | None, min_words: int) -> tuple[int, int, int, int | None]:
    """(words, longest repeated stretch, words in repeated stretches of at least min_words, period)."""
    import numpy as np

    tokens = text.encode("utf-8", "replace").split() if text else []  # bytes: cut at ASCII space
    n = len(tokens)
    if n < 2:
        return n, 0, 0, None
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int32, n)
    levels = _ranks(words)
    order = np.argsort(levels[-1], kind="stable").astype(np.int64)
    shared = _common(levels, order[:-1], order[1:], n)  # neighbours in suffix order share most
    best = np.zeros(n, np.int64)
    best[order[:-1]] = shared
    best[order[1:]] = np.maximum(best[order[1:]], shared)
    long = best >= min_words
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.flatnonzero(long), 1)
    np.add.at(marks, np.flatnonzero(long) + best[long], -1)
    # a text has period p if it goes on like its beginning from p to the end
    starts = np.arange(1, n // 2 + 1)
    periods = starts[_common(levels, np.zeros(len(starts), np.int64), starts, n) == n - starts]
    return n, int(best.max()), int((np.cumsum(marks[:n]) > 0).sum()), int(periods[0]) if len(periods) else None


def repetition_profile(df: DataFrame, key: str, text: str, min_words: int = 8) -> DataFrame:
    """(``key``, n_words, longest_repeat, repeated_words, period) for each row.

    Words are cut at ASCII white space. ``longest_repeat`` is the length in words of the longest stretch that occurs twice, overlaps
    allowed; ``repeated_words`` counts the words that lie in a repeated stretch of at least ``min_words``; ``period`` is the
    least p, at most half the text, with which the whole text repeats itself, null without one. All come from a suffix array
    made by doubling: memory grows with n log n of a single text, time with n (log n)^2.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_repetition(t.as_py(), min_words) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_words", "longest_repeat", "repeated_words", "period"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_words bigint, longest_repeat bigint, repeated_words bigint, period bigint")


def repetition_filter(df: DataFrame, key: str, text: str, min_words: int = 8, max_percent: int = 20) -> DataFrame:
    """``repetition_profile`` with ``kept``: no period, and at most ``max_percent`` of the words repeated."""
    profile = repetition_profile(df, key, text, min_words)
    return profile.withColumn("kept", F.col("period").isNull() & (100 * F.col("repeated_words") <= max_percent * F.col("n_words")))


def script_profile(df: DataFrame, text: str, scripts: tuple[str, ...] = SCRIPTS) -> DataFrame:
    """``df`` with a column of letters for each script, n_letters, the dominant script, its share, and mixed_words.

    Letters outside ``scripts`` count in n_letters only. ``dominant`` is the script with most letters (ties: first in
    ``scripts``), null without letters. ``mixed_words`` counts runs of letters in which a second of the scripts occurs. A null
    text has no letters.
    """
    names = [f"n_{s.lower()}" for s in scripts]
    inside = {s: ("A-Za-z" if s == "Latin" else "") + rf"\p{{Is{s}}}" for s in scripts}  # plain letters need no look at their script
    # counts are lengths of what is left when other runs are taken out: a match a run, not one a letter; only letters
    # outside the first script, few in most texts, are looked through for the other scripts
    whole, letters, rest = (f"_{n}_{text}" for n in ("whole", "letters", "rest"))
    counted = df.select("*", F.coalesce(F.col(text), F.lit("")).alias(whole))
    counted = counted.select("*", F.regexp_replace(whole, r"[^A-Za-z\p{L}]+", "").alias(letters))
    counted = counted.select("*", F.regexp_replace(letters, f"[{inside[scripts[0]]}]+", "").alias(rest))
    counts = [F.length(letters) - F.length(rest), *[F.length(F.regexp_replace(rest, f"[^{inside[s]}]+", "")) for s in scripts[1:]]]
    counted = counted.select("*", F.length(letters).cast("bigint").alias("n_letters"), *[c.cast("bigint").alias(n) for c, n in zip(counts, names)])
    # a word of one script ends where its letters of that script, or of none of them, end
    quick = {s: ("A-Za-z" if s == "Latin" else "") + rf"[\p{{L}}&&\p{{Is{s}}}]" for s in scripts}
    plain = "|".join(rf"[{quick[s]}[\p{{L}}&&[^{''.join(inside[o] for o in scripts if o != s)}]]]*+" if len(scripts) > 1 else r"\p{L}*+" for s in scripts)
    mixed = F.regexp_count(whole, F.lit(rf"(?<!\p{{L}})(?!(?:{plain})(?!\p{{L}}))\p{{L}}++"))
    several = sum((F.col(n) > 0).cast("int") for n in names) > 1
    counted = counted.select("*", F.when(several, mixed).otherwise(0).cast("bigint").alias("mixed_words")).drop(whole, letters, rest)

    most = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    dominant = F.lit(None).cast("string")
    for s, n in reversed(list(zip(scripts, names))):
        dominant = F.when((F.col(n) == most) & (most > 0), s).otherwise(dominant)
    share = F.try_divide(most.cast("double"), F.col("n_letters"))
    return counted.select(*df.columns, "n_letters", *names, dominant.alias("dominant"), share.alias("dominant_share"), "mixed_words")


def char_class_filter(df: DataFrame, text: str, allowed: tuple[str, ...], min_percent: int = 90, scripts: tuple[str, ...] = SCRIPTS) -> DataFrame:
    """``script_profile`` with ``kept``: at least ``min_percent`` of the letters belong to ``allowed`` scripts (or there are none)."""
    profile = script_profile(df, text, scripts)
    inside = sum((F.col(f"n_{s.lower()}") for s in allowed[1:]), F.col(f"n_{allowed[0].lower()}"))
    return profile.withColumn("kept", 100 * inside >= min_percent * F.col("n_letters"))


def topic_scores(df: DataFrame, key: str, text: str, terms: DataFrame, salts: int = 16) -> DataFrame:
    """(``key``, topic, score, n_terms): rows against a table (topic, term, weight) of lower-case words.

    The table is an inverted index: a document's words are counted, then each meets the postings of its term. A term's
    weight is multiplied by its count and by ln(1 + documents / documents with the term). Only pairs that share a term
    appear. Terms are copied ``salts`` times and documents spread over the copies, so a term that every document has is
    split; a document's words are counted before they are shuffled, and only those in the table travel on.
    """
    words = df.select(F.col(key).alias("_id"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt")
    listed = terms.select("topic", "term", F.col("weight").cast("double").alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    known = listed.select("term", "_salt").distinct()
    counts = words.select("_id", "term", salt).join(known, ["term", "_salt"], "left_semi").groupBy("_id", "_salt", "term").agg(F.count("*").alias("tf"))
    having = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("n")).scalar()
    rarity = having.select("term", F.log1p(total / F.col("df")).alias("_idf"))
    weighted = listed.join(rarity, "term").select("topic", "term", "_salt", (F.col("weight") * F.col("_idf")).alias("_weight"))
    return (counts.join(weighted, ["term", "_salt"]).groupBy(F.col("_id").alias(key), "topic")
            .agg(F.sum(F.col("tf") * F.col("_weight")).alias("score"), F.count("*").alias("n_terms")))


def topic_filter(df: DataFrame, key: str, text: str, terms: DataFrame, max_score_per_word: float) -> DataFrame:
    """(``key``, topic, score, n_terms, n_words, kept) for the topic with the highest score of each row (ties by name).

    ``kept`` is false where the score by word exceeds the limit. Rows without a listed term have a null topic and are kept.
    """
    scored = topic_scores(df, key, text, terms)
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("_less"), "topic", "n_terms")).alias("_best"))
    n_words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).cast("bigint")
    rows = df.select(key, n_words.alias("n_words")).join(best, key, "left")
    score = F.coalesce(-F.col("_best._less"), F.lit(0.0))
    return rows.select(key, F.col("_best.topic").alias("topic"), score.alias("score"), F.coalesce("_best.n_terms", F.lit(0)).cast("bigint").alias("n_terms"),
                       "n_words", (score <= max_score_per_word * F.col("n_words")).alias("kept"))


# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def mentioned_dates(text: Column) -> Column:
    """array<date>: the dates that a text names, in order of place within each form.

    ``2024-03-05``, then ``5 March 2024``, then ``March 5, 2024``, then ``March 2024`` (its first day). What is no day of the
    calendar is left out.
    """
    whole = F.lower(F.coalesce(text, F.lit("")))
    month = "(" + "|".join(MONTHS) + ")"

    def dates(pattern: str, year: str, name: str | None, day: str | None) -> Column:
        def one(hit: Column) -> Column:
            number = F.regexp_extract(hit, name, 1)
            for i, m in enumerate(MONTHS):
                number = F.when(F.regexp_extract(hit, name, 1) == m, F.lit(f"{i + 1:02d}")).otherwise(number)
            in_month = F.lpad(F.regexp_extract(hit, day, 1), 2, "0") if day else F.lit("01")
            return F.try_to_date(F.concat_ws("-", F.regexp_extract(hit, year, 1), number, in_month), "yyyy-MM-dd")

        return F.filter(F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), one), lambda d: d.isNotNull())

    return F.concat(
        dates(r"\b\d{4}-\d{2}-\d{2}\b", r"^(\d{4})", r"-(\d{2})-", r"(\d{2})$"),
        dates(rf"\b\d{{1,2}} {month} \d{{4}}\b", r"(\d{4})$", month, r"^(\d{1,2})"),
        dates(rf"\b{month} \d{{1,2}}, \d{{4}}\b", r"(\d{4})$", month, r" (\d{1,2}),"),
        dates(rf"(?<!\d )\b{month} \d{{4}}\b", r"(\d{4})$", month, None))


def cutoff_filter(df: DataFrame, text: str, latest: str) -> DataFrame:
    """``df`` with first_date, last_date, n_dates, and ``kept``: no date that the text names is after ``latest``."""
    dates = df.withColumn("_dates", mentioned_dates(F.col(text)))
    last = F.array_max("_dates")
    return dates.select(*df.columns, F.array_min("_dates").alias("first_date"), last.alias("last_date"), F.size("_dates").cast("bigint").alias("n_dates"),
                        F.coalesce(last <= F.lit(latest).cast("date"), F.lit(True)).alias("kept"))


def licence_verdict(line: Column, rules=LICENCE_RULES) -> Column:
    """The verdict of one licence line: ``refused``, ``unclear`` or ``allowed``.

    The line is read as alternatives (``or``), each a list of licences that all apply (``and``, ``with``): the worst of a list,
    then the best of the alternatives counts. In each part the first rule that fits decides, rules going from the most
    specific to the least. A part that names no known licence is unclear.
    """
    def rank(part: Column) -> Column:
        out = F.lit(_VERDICTS.index("unclear"))
        for pattern, _, verdict in reversed(rules):
            out = F.when(part.rlike(pattern), F.lit(_VERDICTS.index(verdict))).otherwise(out)
        return out

    alternatives = F.split(F.lower(line), r"\s+or\s+|\s*\|\|?\s*")
    worst = F.transform(alternatives, lambda a: F.array_min(F.transform(F.split(a, r"\s+(?:and|with)\s+|\s*&&?\s*"), rank)))
    return F.element_at(F.array(*[F.lit(v) for v in _VERDICTS]), F.array_max(worst) + 1)


def licence_lines(text: Column) -> Column:
    """The lines of a text that speak of a licence."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(_LICENCE_LINE))


def licence_names(line: Column, rules=LICENCE_RULES) -> Column:
    """The names of the known licences that a line speaks of, each part's most specific, sorted."""
    def name(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, known, _ in reversed(rules):
            out = F.when(part.rlike(pattern), known).otherwise(out)
        return out

    parts = F.split(F.lower(line), r"\s+(?:or|and|with)\s+|\s*[|&]+\s*")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, name), lambda n: n.isNotNull())))


def license_filter(df: DataFrame, text: str, rules=LICENCE_RULES) -> DataFrame:
    """``df`` with n_licence_lines, licences, licence (the worst verdict of all lines) and ``kept`` (allowed).

    A text without a licence line is ``unclear``; unclear rows stay in the result, to be reported.
    """
    lined = df.withColumn("_lines", licence_lines(F.col(text)))
    verdicts = F.transform("_lines", lambda line: licence_verdict(line, rules))
    licence = F.when(F.array_contains(verdicts, "refused"), "refused").when(F.array_contains(verdicts, "unclear") | (F.size("_lines") == 0), "unclear").otherwise("allowed")
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("_lines", lambda line: licence_names(line, rules))))), ",")
    judged = lined.select(*df.columns, F.size("_lines").cast("bigint").alias("n_licence_lines"), names.alias("licences"), licence.alias("licence"))
    return judged.withColumn("kept", F.col("licence") == "allowed")
