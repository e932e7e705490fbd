"""SimHash near-duplicates by anchor-point covering.

A fingerprint is the majority, bit by bit, of the XXH64 values of a text's word shingles. Fingerprints that
differ in few bits are found with a covering code: the low 46 bits are two words of the binary Golay code
[23, 12, 7], which is perfect with covering radius 3, so every fingerprint has one home anchor among 2**24.
If two fingerprints differ in at most ``max_bits`` bits, the second lies within radius + ``max_bits`` of the
first one's home anchor. Each fingerprint is replicated to all anchors that near, and an equi-join on the
anchor compares replicas with the fingerprints at home there, over all 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import map_columns, struct
from .components import components

_GOLAY = 0xAE3  # fixed value: generator polynomial of the binary Golay code
_BITS, _CHECK, _RADIUS, _LOW = 23, 11, 3, 12
#: Fingerprints at one anchor up to which they are compared one by one.
ANCHOR_LIMIT = 4096


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split() if text else []  # bytes: only A-Z change, ASCII space splits
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(shingle_words)])))
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start:start + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 3) -> DataFrame:
    """(``id_col``, fp): the signed 64-bit fingerprint of every row."""
    def run(columns):
        import numpy as np

        prints = np.array([fingerprint(t, shingle_words) for t in columns["_text"]], np.uint64).view(np.int64)
        return {"_id": columns["_id"], "fp": prints}

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_columns(rows, run, struct("_id long, fp long"), 256).withColumnRenamed("_id", id_col)


def _covering_tables(max_bits: int):
    """Syndromes of the low 12 and the high 11 bits of a word and, per syndrome, the error patterns of weight
    up to radius + max_bits with what each exceeds the radius by.

    Rows are padded to the longest; a pad exceeds by more than any search allows.
    """
    from itertools import combinations

    import numpy as np

    unit = []
    for i in range(_BITS):
        rest = 1 << i
        for top in range(_BITS - 1, _CHECK - 1, -1):
            if rest >> top & 1:
                rest ^= _GOLAY << (top - _CHECK)
        unit.append(rest)
    found = [[] for _ in range(1 << _CHECK)]
    for weight in range(_RADIUS + max_bits + 1):
        for places in combinations(range(_BITS), weight):
            syndrome = pattern = 0
            for p in places:
                syndrome ^= unit[p]
                pattern |= 1 << p
            found[syndrome].append((pattern, max(0, weight - _RADIUS)))
    width = max(map(len, found))
    patterns = np.zeros((1 << _CHECK, width), np.int64)
    excess = np.full((1 << _CHECK, width), 99, np.int8)
    for s, row in enumerate(found):
        for j, (pattern, over) in enumerate(row):
            patterns[s, j], excess[s, j] = pattern, over

    def syndromes(units):
        table = np.zeros(1 << len(units), np.int64)
        for i, u in enumerate(units):
            table[1 << i:2 << i] = table[:1 << i] ^ u
        return table

    return syndromes(unit[:_LOW]), syndromes(unit[_LOW:]), patterns, excess


def _anchors(prints, max_bits: int, tables):
    """For int64 fingerprints: the index into ``prints`` and the anchor of each replica, and the home anchors."""
    import numpy as np

    of_low, of_high, patterns, excess = tables
    mask = (1 << _BITS) - 1
    low, high = prints & mask, (prints >> _BITS) & mask
    s, t = (of_low[w & ((1 << _LOW) - 1)] ^ of_high[w >> _LOW] for w in (low, high))
    near = (excess[s][:, :, None] + excess[t][:, None, :]) <= max_bits
    row, i, j = np.nonzero(near)
    anchor = ((low[row] ^ patterns[s[row], i]) << _BITS) | (high[row] ^ patterns[t[row], j])
    home = ((low ^ patterns[s, 0]) << _BITS) | (high ^ patterns[t, 0])
    return row, anchor, home


def anchor_replicas(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(anchor, fp, home): one row per anchor within covering radius + ``max_bits`` of each fingerprint.

    Each fingerprint becomes some 60 rows (at two bits), so fingerprints that fit one small partition are spread over as many as a shuffle has.
    """
    tables = _covering_tables(max_bits)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(columns):
        import numpy as np

        fp = np.array(columns["fp"], np.int64)
        row, anchor, home = _anchors(fp, max_bits, tables)
        return {"anchor": anchor, "fp": fp[row], "home": home[row] == anchor}

    return map_columns(prints.select("fp").repartition(parts, "fp"), run, struct("anchor long, fp long, home boolean"), 2048)


def fingerprint_links(prints: DataFrame, max_bits: int = 2, anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within ``max_bits`` bits.

    ``prints`` has one row per distinct fingerprint. At an anchor with at most ``anchor_limit`` replicas every
    close pair becomes a link. A denser anchor would emit the square of its size; its fingerprints are linked
    through the words one bit away from them instead (two fingerprints within two bits share such a word, and
    all that share one are within two bits), each to the least at that word: the same components from a
    linear number of links. That way holds for ``max_bits`` up to 2; beyond it dense anchors are compared too.
    """
    replicas = materialise(anchor_replicas(prints, max_bits), "anchors")
    if max_bits > 2:
        anchor_limit = None
    sparse = replicas
    if anchor_limit is not None:
        dense = replicas.groupBy("anchor").count().filter(F.col("count") > anchor_limit).select("anchor")
        dense = materialise(dense, "dense")
        sparse = replicas.join(dense, "anchor", "left_anti")
    home = sparse.filter("home").select("anchor", F.col("fp").alias("b"))
    others = sparse.select("anchor", F.col("fp").alias("a"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    links = others.join(home, (others["anchor"] == home["anchor"]) & (F.col("a") != F.col("b")) & close)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if anchor_limit is None:
        return links
    crowded = replicas.join(dense, "anchor", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)])
    words = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = words.join(least, "word").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return links.unionByName(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """(``id_col``, fp, component_id): the least id reachable through fingerprints within ``max_bits`` bits.

    Null and empty texts and those without words have fingerprint 0 and are linked like any other. Rows with
    one id each keep their row; a null id keeps its fingerprint and takes the component of its fingerprint.
    Equal fingerprints count once in the search, so groups of exact copies cost nothing. Columns besides the
    two named are not looked at. An empty table gives an empty result.
    """
    rows = materialise(with_fingerprints(docs, id_col, text_col, shingle_words), "prints")
    least = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-prints")
    links = materialise(fingerprint_links(least, max_bits), "links")
    groups = components(links, "a", "b").select(F.col("node").alias("fp"), "component")
    linked = least.join(groups, "fp")
    root = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(root, "component").select("fp", F.col("component_id").alias("_joined"))
    of_print = least.join(moved, "fp", "left").select("fp", F.coalesce("_joined", "least").alias("component_id"))
    return rows.join(of_print, "fp").select(id_col, "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
               max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that are the first (least id) of their group of near copies.

    Columns stay as they are, whatever their names. Rows that repeat a kept id are all kept; rows without an id go.
    """
    groups = simhash_components(docs, id_col, text_col, shingle_words, max_bits)
    firsts = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_first")).distinct()
    return docs.join(firsts, docs[id_col].cast("bigint") == firsts["_first"], "left_semi")
