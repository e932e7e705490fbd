"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, with column functions only.

A text is a set of paragraph digests. Its fingerprint is a small table of cells; each digest is added to one
cell in each of three segments, where cells keep a count, the XOR of digests and the XOR of check hashes. Two
fingerprints subtract cell by cell: what both texts have cancels out, and peeling cells that hold one digest
recovers the digests that only one text has. If the difference is too large for the table, both texts are
sketched again with more cells: digests are dealt to buckets by their top bits, and a bucket that cannot be
peeled is tried again with twice the cells until it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.order import running

SEGMENTS = 3
#: Cells of a segment in a fingerprint; a table of 24 cells recovers about twelve differing paragraphs.
WIDTH = 8
#: Digests of both texts that a bucket holds on average when a comparison is tried larger.
BUCKET_DIGESTS = 8
#: How often a bucket's cells are doubled; then (not seen in practice) its digests are compared one by one.
ATTEMPTS = 8
#: A paragraph is a line, cut at the first end of a sentence after this many characters, again and again.
PARAGRAPH_CHARS = 300
_PARAGRAPH = rf"[^\n]{{{PARAGRAPH_CHARS},}}?[.!?](?=\s)|[^\n]+"
_CELL = "struct<n:bigint,key:bigint,check:bigint>"
_FOUND = "array<struct<sign:bigint,key:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text without blank ones and without white space around them; null counts as empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARAGRAPH), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"^\s+|\s++$", "")), lambda p: p != "")


def paragraph_digests(text: Column) -> Column:
    """array<bigint>, distinct: a digest for each paragraph and the number of times that it occurs.

    Equal texts have equal arrays. Another number of occurrences makes another digest, so repeats count.
    """
    ordered = F.sort_array(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))

    def counted(d: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1))),
                          lambda i: (i <= F.size(d)) & ((i == 1) | (F.get(d, i - 1) != F.get(d, i - 2))))
        return _let(places, lambda s: F.transform(s, lambda at, n: F.xxhash64(
            F.get(d, at - 1), F.coalesce(F.get(s, n + 1), F.size(d) + 1) - at)))

    return _let(ordered, counted)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(0x5EED)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(signed: Column, width: Column) -> Column:
    """Digests with sign, check hash and the three cells that each one goes to; another width deals them anew."""
    def entry(x: Column) -> Column:
        return _let(F.xxhash64(x["key"], width), lambda dealt: F.struct(
            x["sign"].alias("sign"), x["key"].alias("key"), _check(x["key"]).alias("check"),
            *[(F.shiftrightunsigned(dealt, 20 * j).bitwiseAND(width - 1) + j * width).cast("int").alias(f"c{j}") for j in range(SEGMENTS)]))

    return F.transform(signed, entry)


def _add(cells: Column, signed: Column, width: Column) -> Column:
    """The cells with digests added (sign 1) or taken away (sign -1)."""
    def changed(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + x["sign"]).alias("n"), acc["key"].bitwiseXOR(x["key"]).alias("key"),
                        acc["check"].bitwiseXOR(x["check"]).alias("check"))

    return _let(_entries(signed, width), lambda items: F.transform(cells, lambda cell, i: F.aggregate(
        items, cell, lambda acc, x: F.when((x["c0"] == i) | (x["c1"] == i) | (x["c2"] == i), changed(acc, x)).otherwise(acc))))


def _signed_sketch(signed: Column, width: Column) -> Column:
    empty = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "key", "check")])
    return _add(F.array_repeat(empty, (SEGMENTS * width).cast("int")), signed, width)


def sketch(digests: Column, width: int = WIDTH) -> Column:
    """array<struct<n, key, check>>: the cells of a set of digests; ``width`` cells a segment, a power of two."""
    one = F.lit(1).cast("bigint")
    return _signed_sketch(F.transform(digests, lambda d: F.struct(one.alias("sign"), d.alias("key"))), F.lit(width).cast("bigint"))


def subtract(a: Column, b: Column) -> Column:
    """The cells of ``a`` without those of ``b``; both have the same size."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"),
                                                  x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column) -> Column:
    """struct<ok, found>: the digests that subtracted cells hold, with sign 1 (first text only) or -1.

    ``ok`` says whether every cell was emptied; otherwise ``found`` is only a part. In rounds, all digests that are
    alone in a cell are found and taken out of their other cells, until no cell holds a single one.
    """
    def alone(c: Column) -> Column:
        single = F.filter(c, lambda x: (F.abs(x["n"]) == 1) & (x["check"] == _check(x["key"])))
        return F.array_distinct(F.transform(single, lambda x: F.struct(x["n"].alias("sign"), x["key"].alias("key"))))

    def run(start: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            width = F.call_function("div", F.size(acc["cells"]), F.lit(SEGMENTS))
            out = F.transform(acc["next"], lambda x: F.struct((-x["sign"]).alias("sign"), x["key"].alias("key")))
            left = _add(acc["cells"], out, width)
            return F.when(F.size(acc["next"]) == 0, acc).otherwise(_let(left, lambda c: F.struct(
                c.alias("cells"), alone(c).alias("next"), F.concat(acc["found"], acc["next"]).alias("found"))))

        begin = F.struct(start.alias("cells"), alone(start).alias("next"), F.array().cast(_FOUND).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.size(start)), begin, step, lambda acc: F.struct(
            (~F.exists(acc["cells"], lambda x: (x["n"] != 0) | (x["key"] != 0) | (x["check"] != 0))).alias("ok"),
            acc["found"].alias("found")))

    return _let(cells, run)


def _exactly(signed: Column) -> Column:
    def keys(sign: int) -> Column:
        return F.transform(F.filter(signed, lambda x: x["sign"] == sign), lambda x: x["key"])

    both = F.array_intersect(keys(1), keys(-1))
    return F.filter(signed, lambda x: ~F.array_contains(both, x["key"]))


def _bucket_difference(signed: Column, width: Column) -> Column:
    """The signed digests of one bucket that do not cancel out: subtracted sketches of growing size, peeled.

    The second text's digests are taken from the cells that hold the first text's, which subtracts the sketches.
    """
    def attempt(acc: Column, t: Column) -> Column:
        return F.when(acc["ok"], acc).otherwise(peel(_signed_sketch(signed, F.call_function("shiftleft", width, t))))

    begin = F.struct(F.lit(False).alias("ok"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), begin, attempt,
                       lambda acc: F.when(acc["ok"], acc["found"]).otherwise(_exactly(signed)))


def _larger(left: Column, right: Column) -> Column:
    """All signed digests by which two sets differ: buckets by the digests' top bits, sketched one by one."""
    total = F.size(left) + F.size(right)
    bits = F.greatest(F.ceil(F.log2(F.greatest(total, F.lit(1)) / F.lit(BUCKET_DIGESTS))), F.lit(0)).cast("int")

    def dealt(b: Column) -> Column:
        def entry(sign: int):
            # the two shifts give bucket 0 where there is one bucket only
            return lambda k: F.struct(F.call_function("shiftrightunsigned", F.shiftrightunsigned(k, 1), F.lit(63) - b).alias("bucket"),
                                      F.lit(sign).cast("bigint").alias("sign"), k.alias("key"))

        return F.sort_array(F.concat(F.transform(left, entry(1)), F.transform(right, entry(-1))))

    def runs(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1))), lambda i: (i <= F.size(e)) & (
            (i == 1) | (F.get(e, i - 1)["bucket"] != F.get(e, i - 2)["bucket"])))
        return _let(starts, lambda s: F.transform(s, lambda at, n: F.transform(
            F.slice(e, at, F.coalesce(F.get(s, n + 1), F.size(e) + 1) - at),
            lambda x: F.struct(x["sign"].alias("sign"), x["key"].alias("key")))))

    def solve(b: Column) -> Column:
        width = F.when(b == 0, F.lit(2 * WIDTH)).otherwise(F.lit(WIDTH)).cast("bigint")  # a lone bucket was tried already
        return F.flatten(F.transform(_let(dealt(b), runs), lambda run: _bucket_difference(run, width)))

    return _let(bits, solve)


def differences(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """array<struct<sign, key>>: the digests that only one of two texts has.

    ``left`` and ``right`` are their digests, the cells their fingerprints. The fingerprints alone decide where their
    difference can be peeled; else larger sketches are made.
    """
    return _let(peel(subtract(left_cells, right_cells)), lambda p: F.when(p["ok"], p["found"]).otherwise(_larger(left, right)))


def likeness(left: Column, right: Column, found: Column) -> Column:
    """Shared digests by all digests, 0 to 1; two texts without paragraphs are alike."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(F.size(found), lambda n: (both - n) / (both + n)))


def fingerprint_text(cells: Column) -> Column:
    """The cells as text: for each the count, digest and check in hexadecimal digits, all in base 64."""
    one = F.array_join(F.transform(cells, lambda c: F.concat(
        F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 8, "0"))), "")
    return F.base64(F.unhex(one))


def cells_of(fingerprint: Column) -> Column:
    """The cells that ``fingerprint_text`` wrote."""
    def number(digits: Column) -> Column:  # two halves, since 16 digits may exceed what a signed number holds
        high, low = (F.conv(part, 16, 10).cast("bigint") for part in (F.substring(digits, 1, 8), F.substring(digits, 9, 8)))
        return F.shiftleft(high, 32).bitwiseOR(low)

    parts = F.regexp_extract_all(F.hex(F.unbase64(fingerprint)), F.lit("[0-9A-F]{32}"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(
        F.conv(F.substring(p, 1, 8), 16, 10).cast("bigint").alias("n"), number(F.substring(p, 9, 16)).alias("key"),
        F.conv(F.substring(p, 25, 8), 16, 10).cast("bigint").alias("check")))


def compare_versions(df: DataFrame, old_col: str, new_col: str) -> DataFrame:
    """``df`` with the fingerprints of two texts, what differs between them, and their likeness.

    Adds old_fingerprint, new_fingerprint, only_old and only_new (digests of the paragraphs that one text has and
    the other has not, or has another number of times) and likeness. Null texts count as empty. Columns of ``df``
    must not have these names. Rows are looked at one by one: nothing is shuffled.
    """
    with_digests = df.withColumn("_old", paragraph_digests(F.col(old_col).cast("string"))).withColumn(
        "_new", paragraph_digests(F.col(new_col).cast("string")))
    with_cells = with_digests.withColumn("_old_cells", sketch(F.col("_old"))).withColumn("_new_cells", sketch(F.col("_new")))
    found = with_cells.withColumn("_found", differences(*[F.col(c) for c in ("_old", "_new", "_old_cells", "_new_cells")]))

    def only(sign: int) -> Column:
        return F.array_sort(F.transform(F.filter("_found", lambda x: x["sign"] == sign), lambda x: x["key"]))

    return found.select(*[F.col(f"`{c}`") for c in df.columns], fingerprint_text(F.col("_old_cells")).alias("old_fingerprint"),
                        fingerprint_text(F.col("_new_cells")).alias("new_fingerprint"), only(1).alias("only_old"),
                        only(-1).alias("only_new"), likeness(F.col("_old"), F.col("_new"), F.col("_found")).alias("likeness"))


def document_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against an edited version of it and against the next document.

    (``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next document
    is the one with the next smaller id, after the last one the first. The edited text has the last half of the
    characters replaced by as many from the beginning of the next document, or by all of it if it is shorter.

    A null text is empty. Rows with one id and different texts follow each other in an order fixed by the texts' hash,
    equal rows are one version and each get its result, a null id is smaller than any other. An only document is its own
    next. Other columns are not looked at. An empty table gives an empty result.

    Order is found on narrow keys. Texts are shuffled once by key, and their beginnings once more to the document before
    them; no group is gathered.
    """
    own_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # both joins below read the same columns of the texts, so these are shuffled once
    key = ["_k", "_missing", "_h"]
    rows = docs.select(F.coalesce(own_id, F.lit(-2 ** 63)).alias("_k"), own_id.isNull().alias("_missing"),
                       F.xxhash64(text).alias("_h"), text.alias("_text"))
    numbered = running(rows.select(*key, F.length("_text").alias("_n")).distinct(), key, index_col="_at", carry=["_n"])
    total = numbered.agg(F.count("*").alias("_n")).scalar()
    following = numbered.select(*[F.col(c).alias(f"_next{c}") for c in key], F.col("_at").alias("_next_at"))
    wanted = (numbered.withColumn("_next_at", F.pmod(F.col("_at") - 1, total)).join(following, "_next_at")
              .select(*[F.col(f"_next{c}").alias(c) for c in key], *[F.col(c).alias(f"_to{c}") for c in key], F.shiftright("_n", 1).alias("_half")))
    lead = rows.join(wanted, key).select(
        *[F.col(f"_to{c}").alias(c) for c in key], F.substring(F.col("_text"), F.lit(1), F.col("_half")).alias("_lead"),
        paragraph_digests(F.col("_text")).alias("_next"))
    lead = lead.groupBy(*key).agg(F.first(F.struct("_lead", "_next")).alias("_from_next"))  # repeated rows are equal
    both = rows.join(lead, key).select(F.when(~F.col("_missing"), F.col("_k")).alias("_id"), "_text",
                                       F.col("_from_next._lead").alias("_lead"), F.col("_from_next._next").alias("_next"))
    n = F.length("_text")
    edited = both.select("*", n.alias("_n"), F.concat(F.substring(F.col("_text"), F.lit(1), n - F.shiftright(n, 1)), F.col("_lead")).alias("_edited"))
    digests = edited.select("_id", "_n", F.sha2("_edited", 256).alias("edited_sha256"), paragraph_digests(F.col("_text")).alias("_own"),
                            paragraph_digests(F.col("_edited")).alias("_new"), "_next")
    cells = digests.select("*", *[sketch(F.col(c)).alias(f"{c}_cells") for c in ("_own", "_new", "_next")])

    def near(other: str) -> Column:
        found = differences(F.col("_own"), F.col(other), F.col("_own_cells"), F.col(f"{other}_cells"))
        return likeness(F.col("_own"), F.col(other), found)

    return cells.select(F.col("_id").alias(id_col), F.col("_n").cast("bigint").alias("n_chars"), "edited_sha256",
                        fingerprint_text(F.col("_own_cells")).alias("fingerprint"),
                        fingerprint_text(F.col("_new_cells")).alias("edited_fingerprint"),
                        near("_new").alias("near_edited"), near("_next").alias("near_next"))
