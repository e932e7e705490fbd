"""Near copies by five-word similarity: SimHash anchors, widened by shingle bands, decided by exact comparison.

Two texts with a Jaccard similarity of 0.8 over their five-word shingles differ in about ten of 64 SimHash bits, and a
covering of that many bits would replicate each fingerprint to thousands of anchors. So anchors find the copies
within a few bits, bands of min-hashes of the same shingles find the others, the share of equal min-hashes throws out
candidates that are too far apart to be similar, and the shingle sets of the remaining pairs are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import map_columns, struct
from .components import components
from .passages import Shingler, mixed
from .simhash import fingerprint_links

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bands of min-hashes and their width: a pair of similarity 0.8 shares one in 998 of 1,000 cases.
BANDS, BAND_ROWS = 16, 5
#: Of the 80 min-hashes of the bands, how many a candidate has to share, told by a byte of each: at similarity 0.8 fewer
#: are shared about once in a million pairs; at 0.4 as many are shared about once in 400.
LEAST_SHARED = 45
#: Members from which on a bucket that one leader has not settled has parities taken of its texts.
CROWD = 64
#: Bits of a text's parities for each of its shingles, at least.
PARITY_BITS = 4
#: Bits within which anchors find all pairs.
ANCHOR_BITS = 2


def set_fingerprint(shingles) -> int:
    """The signed 64-bit SimHash of distinct shingle hashes: how often one repeats in a text does not count."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 8192):
        part = shingles[start:start + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(shingles)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def text_sketches(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(row, id, digest, fp, least, n, keys) of (row, id, text).

    ``digest`` is that of the word sequence, A-Z as a-z; ``fp`` and ``n`` are of distinct shingles; ``least`` are the min-hashes, a
    byte of each, eight to a number; ``keys`` are one number a band, none for a text of fewer words than a shingle, which is similar to its equals only.
    """
    schema = struct("row long, id long, digest string, fp long, least longs, n long, keys longs")

    def run(columns, state=[]):
        from hashlib import md5

        import numpy as np

        if not state:
            state.append(Shingler())
        out = {n: [] for n in schema.names}
        for row, key, text in zip(columns["row"], columns["id"], columns["text"]):
            shingles = np.unique(state[0].shingles(text, shingle_words))
            keys, least = [], np.zeros(BANDS * BAND_ROWS, np.uint64)
            if len(shingles):
                for band in range(BANDS):
                    key_of = np.zeros(1, np.uint64)
                    for i in range(BAND_ROWS):
                        at = band * BAND_ROWS + i
                        least[at] = mixed(shingles, 1 + at).min()
                        key_of = mixed(key_of ^ least[at], band)
                    keys.append(int(key_of.view(np.int64)[0]))
            words = text.encode("utf-8").lower().split() if text else []
            sketch = mixed(least, 0).astype(np.uint8).view(np.int64).tolist()
            values = (row, key, md5(b" ".join(words)).hexdigest(), set_fingerprint(shingles), sketch, len(shingles), keys)
            for name, value in zip(out, values):
                out[name].append(value)
        return out

    return map_columns(rows.select("row", "id", "text"), run, schema, 128)


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b): the rows of ``pairs`` whose texts, from ``texts`` (row, text), are similar enough."""
    schema = struct("a long, b long")

    def run(columns, state=[]):
        import numpy as np

        if not state:
            state.extend([Shingler(), {}, 0])
        out = {"a": [], "b": []}
        for a, b, text, other in zip(columns["a"], columns["b"], columns["text"], columns["other"]):
            if state[2] > 1_000_000:  # bounds memory
                state[1:] = [{}, 0]
            sets = state[1]
            for row, words in ((a, text), (b, other)):
                if row not in sets:
                    sets[row] = np.unique(state[0].shingles(words, shingle_words))
                    state[2] += len(sets[row])
            one, two = sets[a], sets[b]
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both >= similarity * (len(one) + len(two) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    first, second = texts.select(F.col("row").alias("a"), "text"), texts.select(F.col("row").alias("b"), F.col("text").alias("other"))
    return map_columns(pairs.join(second, "b").join(first, "a").select("a", "b", "text", "other"), run, schema, 32)


def _differing(one: str, other: str):
    """How many bytes of the sketches differ: a byte's bits are folded onto its lowest one."""
    total = F.lit(0)
    for i in range(BANDS * BAND_ROWS // 8):
        bits = F.col(one)[i].bitwiseXOR(F.col(other)[i])
        for n in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        total = total + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def parities(shingles):
    """Of each residue of the hashes, whether an odd number of ``shingles`` has it, as signed 64-bit words, a power of two of them.

    Shingles that two texts share cancel out, so the bits that differ are at most as many as the shingles that only one of the two has.
    """
    import numpy as np

    width = 256
    while width < PARITY_BITS * len(shingles):
        width *= 2
    odd = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def text_parities(classes: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, bits): the parities of each class of ``classes`` (cls)."""
    schema = struct("cls long, bits longs")

    def run(columns, state=[]):
        import numpy as np

        if not state:
            state.append(Shingler())
        return {"cls": columns["row"], "bits": [parities(np.unique(state[0].shingles(text, shingle_words))).tolist() for text in columns["text"]]}

    wanted = classes.select(F.col("cls").alias("row"))
    return map_columns(texts.join(wanted, "row", "left_semi").select("row", "text"), run, schema, 128)


def _odd_bits(one: str, other: str):
    """How many bits of the parities differ, the longer ones folded to the length of the others; null where those are less than half as long."""
    size = F.least(F.size(one), F.size(other))
    folded = [F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))
              for x in (one, other)]
    differ = F.zip_with(*folded, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.when(F.greatest(F.size(one), F.size(other)) <= 2 * size, F.aggregate(differ, F.lit(0), lambda total, n: total + n))


def _compared(marked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each member that ``leads`` with the others of its bucket that links have not joined to it and that may be similar.

    Of two similar texts' shingles at most the share (1 - s) / (1 + s) is in one text only, and their parities (``bits``) differ
    in no more places. Pairs that cannot be similar then are left out; no other is.
    """
    lead = marked.filter("leads").select("key", F.col("cls").alias("_cls"), F.col("least").alias("_least"), F.col("n").alias("_n"),
                                         F.col("bits").alias("_bits"), F.col("component").alias("_component"))
    once = F.col("leads").isNull() | (F.col("cls") < F.col("_cls"))
    sizes = F.least("n", "_n") >= F.lit(similarity) * F.greatest("n", "_n")
    near = _differing("least", "_least") <= BANDS * BAND_ROWS - LEAST_SHARED
    single = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("_n")) + 1e-6
    odd = F.coalesce(_odd_bits("bits", "_bits") <= single, F.lit(True))  # null: no parities to compare
    both = marked.join(lead, "key").filter((F.col("component") != F.col("_component")) & once & sizes & near & odd)
    return both.select(F.least("cls", "_cls").alias("a"), F.greatest("cls", "_cls").alias("b")).distinct()


def linked_classes(members: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame | None:
    """(cls, component) of the classes that are linked, or None: ``members`` are (key, cls, least, n), one row per class of a bucket.

    In each round every bucket has leaders, first the least of it, then the one of most crowded buckets, later that of each of 64, 4096, ... parts (all of
    a bucket with no more members), and they are compared with the members that have not led and are not yet in their component. A bucket is done when those that never led
    are of one component: then all its pairs of different components have been compared, so no link that would join
    two components is lost, while a bucket of n near copies of one text costs n comparisons.
    In crowded buckets that one leader has not settled, texts whose parities rule a link out are not compared.
    """
    members = members.withColumn("shares", F.lit(0).cast("bigint")).withColumn("bits", F.lit(None).cast("array<bigint>"))
    members = members.withColumn("component", F.col("cls")).withColumn("size", F.lit(None).cast("bigint"))
    met, links, groups, crowd, parts = None, None, None, None, 1
    while True:
        part = F.when(F.col("size") <= parts, F.xxhash64("cls")).otherwise(F.pmod(F.xxhash64("cls"), F.lit(parts)))
        first = F.min(F.struct(-F.col("shares"), "cls")).alias("_first")  # a text that shares many bands is near to many
        least = members.groupBy("key", part.alias("_part")).agg(first).select("key", F.col("_first.cls").alias("cls"), F.lit(True).alias("leads"))
        marked = materialise(members.join(least, ["key", "cls"], "left"), "leaders")
        pairs = _compared(marked, similarity)
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        met = pairs if met is None else met.unionByName(pairs)
        wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        found = materialise(similar_pairs(pairs, texts.join(wanted, "row", "left_semi"), shingle_words, similarity), "similar")
        # those that have led have been compared with all others of their bucket and are not needed any more
        never_led = marked.filter("leads is null").drop("leads", "size")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = materialise(components(links, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("_group")), "components")
            never_led = never_led.join(groups, "cls", "left").withColumn("component", F.coalesce("_group", "cls")).drop("_group")
        unsettled = never_led.groupBy("key").agg((F.min("component") < F.max("component")).alias("_open"), F.count("*").alias("size"))
        members = materialise(never_led.join(unsettled.filter("_open").drop("_open"), "key"), "open-buckets")
        if members.isEmpty():
            return None if groups is None else groups.select("cls", F.col("_group").alias("component"))
        if crowd is None:
            # one of each bucket has led
            crowd = members.filter(F.col("size") >= CROWD).groupBy("cls").agg(F.count("*").alias("_shares"))
            crowd = materialise(crowd.join(text_parities(crowd, texts, shingle_words).withColumnRenamed("bits", "_bits"), "cls"), "parities")
            of_crowd = [F.coalesce("_shares", F.lit(0)).alias("shares"), F.col("_bits").alias("bits")]
            members = materialise(members.join(crowd, "cls", "left").select("key", "cls", "least", "n", *of_crowd, "component", "size"), "open-buckets")
        else:
            parts *= 64


def near_copy_groups(rows: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(row, id, first_row) of (row, id, text), where ``row`` is unique: the row that stands for its group.

    Texts with equal word sequences are one class; classes of enough similarity are linked, and groups are what
    links connect. The row with the least id stands for its group (null ids last, then the least row). Null texts,
    empty ones and those without words are one class. An empty table gives an empty result.
    """
    sketches = materialise(text_sketches(rows, shingle_words), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = materialise(sketches.groupBy("digest").agg(F.min("row").alias("cls"), F.min(order).alias("best")), "classes")
    heads = sketches.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").filter("n > 0")
    heads = materialise(heads.select(F.col("row").alias("cls"), "fp", "least", "n", "keys"), "heads")
    links = fingerprint_links(heads.select("fp").distinct(), ANCHOR_BITS)
    anchored = components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("_print"))
    by_print = heads.join(anchored, "fp", "left").select(F.xxhash64(F.lit("anchor"), F.coalesce("_print", "fp")).alias("key"), "cls")
    by_band = heads.select(F.explode("keys").alias("key"), "cls")
    buckets = materialise(by_band.unionByName(by_print), "buckets")
    several = buckets.groupBy("key").count().filter("count > 1").select("key")
    # a text is in many buckets: its min-hashes join those that it shares
    members = materialise(buckets.join(several, "key", "left_semi").join(heads.select("cls", "least", "n"), "cls"), "shared-buckets")
    groups = None if members.isEmpty() else linked_classes(members, rows.select("row", "text"), shingle_words, similarity)
    if groups is None:
        of_class = classes.select("digest", F.col("best.row").alias("first_row"))
    else:
        joined = classes.join(groups, "cls", "left").select("digest", "best", F.coalesce("component", "cls").alias("component"))
        firsts = joined.groupBy("component").agg(F.min("best").alias("first")).select("component", F.col("first.row").alias("first_row"))
        of_class = joined.join(firsts, "component").select("digest", "first_row")
    return sketches.select("row", "id", "digest").join(of_class, "digest").select("row", "id", "first_row")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, one of each group, columns as they are.

    Rows are told apart by a number of their own, so null and repeated ids do no harm: of repeated rows one stays, and a
    row without an id stays unless its group has one with an id or an earlier one without.
    """
    row = "_row"
    while row.lower() in (c.lower() for c in docs.columns):
        row += "_"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = near_copy_groups(rows, shingle_words, similarity).filter("row = first_row").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
