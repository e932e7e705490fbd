"""Secret scans with column expressions only: exact patterns, and a randomness test battery for other tokens.

A long token whose characters fit an encoding (hex, base32, lower-case letters and digits, base64) is tested against the uniform law of that
alphabet: chi-squared on the character counts, runs about the middle of the alphabet, lag-1 serial correlation.
A token is a finding if none of the tests rejects randomness and if, as a member of its stratum of encoding and length, it
also survives Benjamini-Hochberg control against the other hypothesis: that its characters follow the
rank-frequency law of written words, under which so even a count is unlikely, or that they come in words and numbers,
under which so many changes between letters, digits and signs are unlikely (twice the lesser of the two levels counts). Short tokens can hardly tell the
two laws apart, so each length stratum is controlled on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the base scan. A kind's matches are found with its pattern, then filtered by length.
# Letters of ASSIGN are taken in either case as Unicode has it: the long s and the Kelvin sign are cases of s and k.
ASSIGN = r"""(?iu)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # maximal runs, so those of 16 or more are found as such
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: A token is not random if a test rejects at this level (shared by the three tests).
REJECT_LEVEL = 0.001
#: Expected share of word-like tokens among the findings of a stratum.
FALSE_DISCOVERY_RATE = 0.05
#: Kinds of characters in words and numbers change at so many of the steps at most: one in ten where letters have one case,
#: one in five where each word of a name may begin with a capital or a sign.
TURNS = {"hex": 0.1, "base32": 0.1, "base36": 0.1, "base64": 0.2}
_LONGEST_SUM = 2000
_BINS_PER_HALVING = 4
_FOUND = "array<struct<start:bigint,stop:bigint,match:string,inner:string>>"
_SPANS = "array<struct<kind:int,start:bigint,stop:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: array<struct<start, stop, match, inner>> in code points.

    What lies between the matches comes from ``split``, so places are sums of lengths.
    """
    group = 2 if pattern == ASSIGN else 0
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), inner.alias("inner"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["match"])
        one = F.struct(begin.alias("start"), stop.alias("stop"), x["match"].alias("match"), x["inner"].alias("inner"))
        return F.struct(F.coalesce(stop, begin).alias("at"),
                        F.when(x["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    located = F.aggregate(zipped, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), located).otherwise(F.array().cast(_FOUND))


def _spans(located: Column, kind: int, keep=None) -> Column:
    kept = F.filter(located, keep) if keep else located
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, stop>> of the three exact patterns; kinds are places in KINDS."""
    return F.concat(
        _spans(_located(text, ASSIGN), 0, lambda m: F.length(m["inner"]) >= 12),
        _spans(_located(text, ACCESS), 1, lambda m: F.length(m["match"]) >= 18),
        _spans(_located(text, HEX), 2))


def _tail(z: Column) -> Column:
    """Upper tail of the normal law (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def word_law(size: int) -> tuple[float, float]:
    """Sums of squares and of cubes of the rank-frequency law of ``size`` symbols: p(r) = (1/size) * sum of 1/i for i >= r."""
    law, total = [], 0.0
    for r in range(size, 0, -1):
        total += 1 / r
        law.append(total / size)
    return sum(p * p for p in law), sum(p ** 3 for p in law)


def _at_least(count: Column, steps: Column, rate: Column) -> Column:
    """P(X >= count) of the binomial law; Chernoff's bound where the terms would underflow."""
    first = F.struct(F.pow(1 - rate, steps).alias("term"), F.lit(0.0).alias("tail"))

    def step(acc, j):
        return F.struct((acc["term"] * (steps - j) / (j + 1) * (rate / (1 - rate))).alias("term"),
                        (acc["tail"] + F.when(j >= count, acc["term"]).otherwise(0.0)).alias("tail"))

    exact = F.aggregate(F.sequence(F.lit(0), steps.cast("int")), first, step, lambda acc: acc["tail"])
    share = count / steps
    bound = F.exp(-steps * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)))
    return F.when(steps <= _LONGEST_SUM, exact).when(share <= rate, 1.0).otherwise(bound)


def _turns(bare: Column) -> Column:
    """How often the kind of character changes; the step from a capital to a small letter and the one after a sign count as none."""
    kinds = bare
    for pattern, kind in (("[+/_-]", "."), ("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "0")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    chars = F.split(kinds, "(?!^)")
    steps = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1),
                       lambda a, b: (a != b) & (a != ".") & ~((a == "A") & (b == "a")))
    return F.size(F.filter(steps, lambda turn: turn)).cast("double")


def _encoding(token: Column) -> Column:
    """The narrowest encoding that fits a token, with its alphabet and laws; null if none does."""
    digit, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    fits = {"hex": token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & (lower | upper),
            "base32": token.rlike("^[A-Z2-7]+=*$") & digit & upper,
            "base36": token.rlike("^[0-9a-z]+=*$") & digit & lower,
            "base64": digit & lower & upper}
    chosen = F
    for name, fit in fits.items():
        alphabet = ALPHABETS[name]
        s2, s3 = word_law(len(alphabet))
        law = [F.lit(v).alias(n) for n, v in (("encoding", name), ("alphabet", alphabet), ("k", float(len(alphabet))),
                                              ("s2", s2), ("s3", s3), ("rate", TURNS[name]))]
        chosen = chosen.when(fit, F.struct(*law))
    return chosen


def _measured(token: Column, law: Column) -> Column:
    """struct<encoding, length, p_random, p_word> of a token under the encoding of ``law``."""
    k, s2, s3 = law["k"], law["s2"], law["s3"]
    middle = (k - 1) / 2
    bare = F.rtrim(token, F.lit("="))
    plain = F.when(law["encoding"] == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    codes = F.filter(F.transform(F.split(plain, "(?!^)"), lambda c: F.instr(law["alphabet"], c) - 1), lambda c: c >= 0)

    counted = F.struct(_turns(bare).alias("turns"), (F.length(bare).cast("double") - 1).alias("steps"))
    by_turns = _let(counted, lambda t: _at_least(t["turns"], t["steps"], law["rate"]))

    def measures(x: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(0.0),
                              lambda acc, i: acc + F.pow(F.size(F.filter(x, lambda c: c == i)), F.lit(2.0)))
        chi = squares * k / n - n
        spread = 2 / (9.0 * (k - 1))
        z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        high = F.size(F.filter(x, lambda c: c * 2 >= k)).cast("double")
        low = n - high
        steps = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1),
                           lambda a, b: F.struct(((a * 2 >= k) != (b * 2 >= k)).alias("turn"),
                                                 ((a - middle) * (b - middle)).alias("product")))
        both = 2 * high * low
        run_var = both * (both - n) / (n * n * (n - 1))

        def rest(s: Column) -> Column:
            runs = 1 + F.size(F.filter(s, lambda e: e["turn"]))
            z_runs = F.when(run_var > 0, (runs - 1 - both / n) / F.sqrt(run_var)).otherwise(99.0)
            product = F.aggregate(s, F.lit(0.0), lambda acc, e: acc + e["product"])
            energy = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + F.pow(c - middle, F.lit(2.0)))
            z_serial = F.when(energy > 0, product / energy * F.sqrt(n)).otherwise(99.0)
            p_random = F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))
            expected = k * (1 - s2) + n * (k * s2 - 1)
            variance = 2.0 * k * k * (n - 1) / n * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
            by_counts = _tail((expected - chi) / F.sqrt(variance))
            p_word = F.least(2 * F.least(by_counts, by_turns), F.lit(1.0))
            return F.struct(law["encoding"].alias("encoding"), F.size(x).alias("length"), p_random.alias("p_random"), p_word.alias("p_word"))

        return _let(steps, rest)

    return _let(codes, measures)


def _inferred(token: Column) -> Column:
    """The measures of a token under the narrowest encoding that fits it, null if none does."""
    return _let(_encoding(token), lambda law: F.when(law.isNotNull(), _measured(token, law)))


def candidates(text: Column) -> Column:
    """array<struct<start, stop, encoding, length, p_random, p_word>> of the tokens that fit an encoding."""
    found = F.transform(_located(text, CANDIDATE), lambda m: F.struct(
        m["start"].alias("start"), m["stop"].alias("stop"), _inferred(m["match"]).alias("m")))
    return F.transform(F.filter(found, lambda c: c["m"].isNotNull()), lambda c: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), _stratum(c["m"]).alias("stratum"),
        c["m"]["p_random"].alias("p_random"), _bin(c["m"]["p_word"]).alias("bin")))


def _stratum(m: Column) -> Column:
    """Encoding and length, by halves of a power of two."""
    return F.concat_ws(":", m["encoding"], F.floor(2 * F.log2(m["length"].cast("double"))).cast("string"))


def _bin(p: Column) -> Column:
    """p <= 2 ** (-bin / 4); bins end at 2 ** -100."""
    return F.floor(_BINS_PER_HALVING * F.least(-F.log2(F.greatest(p, F.lit(1e-300))), F.lit(100.0))).cast("int")


def _random(c: Column) -> Column:
    return c["p_random"] >= REJECT_LEVEL / 3


def discovery_limits(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> dict[str, int]:
    """The least bin of p_word that counts as a discovery, for each stratum that has one.

    Benjamini-Hochberg over all tokens of all rows that pass the battery, from their counts in at most 401 bins per
    stratum; only the limits, one number for each of some dozens of strata, come to the driver.
    """
    text = F.col(text_col).cast("string")
    # most texts have no candidate; they leave before anything is taken apart
    rows = docs.select(text.alias("_text")).filter(F.col("_text").rlike(CANDIDATE))
    tokens = rows.select(F.explode(candidates(F.col("_text"))).alias("c")).select("c.*").filter(_random(F.struct(F.col("p_random").alias("p_random"))))
    bins = tokens.groupBy("stratum", "bin").count()
    return _benjamini_hochberg(bins, rate)


def _benjamini_hochberg(bins: DataFrame, rate: float) -> dict[str, int]:
    counts: dict[str, dict[int, int]] = {}
    for r in bins.collect():  # bounded: strata times bins
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    limits = {}
    for stratum, by_bin in counts.items():
        total, above = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            above += by_bin[b]
            if 2 ** (-b / _BINS_PER_HALVING) <= rate * above / total:
                limits[stratum] = b
    return limits


def secret_spans(text: Column, limits: dict[str, int]) -> Column:
    """All spans of a text, by start and kind: array<struct<kind, start, stop>>; kinds are places in KINDS."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    base = base_spans(text)
    if limits:
        table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        kept = F.filter(candidates(text), lambda c: _random(c) & (c["bin"] >= F.coalesce(F.element_at(table, c["stratum"]), F.lit(10 ** 6))))
        base = F.concat(base, F.transform(kept, lambda c: F.struct(F.lit(3).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))))
    by_start = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).cast(_SPANS)


def scan_secrets(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE, spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans_col``: places of secrets in code points, end exclusive; empty for null or clean texts.

    Whole texts are scanned, every row keeps its place, and other columns stay as they are. The discovery limits
    are worked out over all rows first. A column that already has the name ``spans_col`` is replaced.
    """
    return docs.withColumn(spans_col, secret_spans(F.col(text_col), discovery_limits(docs, text_col, rate)))


def spans_text(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``; overlapping spans become one. A null text stays null."""
    text = F.col(text_col)

    def replaced(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc, s):
            apart = s["start"] >= acc["at"]
            gap = text.substr((acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                            F.when(apart, F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"]).alias("parts"))

        whole = F.aggregate(spans, start, step, lambda acc: F.concat(
            F.array_join(acc["parts"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text).cast("int"))))
        return F.when(F.size(spans) > 0, whole).otherwise(text)

    limits = discovery_limits(docs, text_col, rate)
    return docs.withColumn(text_col, _let(secret_spans(text, limits), replaced))
