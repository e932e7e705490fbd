"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary's words are put into blocked Bloom filters, one for each word length, which are broadcast at a
bounded size. Each word generates its edits: every deletion, looked up among the words that are one shorter, and
every replacement by a greater letter, looked up among those of its own length. (Insertions are the deletions of
the longer word, replacements by smaller letters those of the other word.) Only edits that pass a filter become
strings and are shuffled to an exact join with the vocabulary, which removes what passed wrongly.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import map_columns, struct

#: Bits of a filter for each word, 64-bit words in a block, bits that a word sets.
BITS_PER_WORD, BLOCK_WORDS, HASH_BITS = 16, 8, 6
#: Blocks of all filters together at most (64 bytes each): the bound of what is broadcast, 64 MB. Longer vocabularies make
#: fuller filters, so that more edits reach the exact join, which still decides.
MAX_BLOCKS = 1 << 20
#: Of the words, one in this many is misspelt by ``document_words``.
MISSPELT = 31
#: Words that a probing task gets, about.
TASK_WORDS = 20_000
_RUN = "[a-zÀ-ÿ]+"


def _mix(x):
    """A 64-bit finaliser (the public splitmix64 constants) on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter_hash(position, code):
    """The share of a letter in a word's hash: words hash to the XOR of their letters' shares."""
    import numpy as np

    return _mix(np.asarray(position, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(code, np.uint64) + np.uint64(1))


def _matrix(words: list[str]):
    """Code points of equally long words, a row each."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _word_hash(codes):
    import numpy as np

    return np.bitwise_xor.reduce(_letter_hash(np.arange(codes.shape[1], dtype=np.uint64), codes), axis=1)


def _places(hashes, blocks: int):
    """Block of each hash, and its bits: six numbers below 512."""
    import numpy as np

    first, second = _mix(hashes), _mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return (first % np.uint64(blocks)).astype(np.int64), [(second >> np.uint64(9 * j)) & np.uint64(511) for j in range(HASH_BITS)]


def _by_length(words):
    """(length, row numbers, words) for each length."""
    rows = {}
    for i, w in enumerate(words):
        rows.setdefault(len(w), []).append(i)
    return [(n, at, [words[i] for i in at]) for n, at in sorted(rows.items()) if n]


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` letters occurs.

    Words are maximal runs of Latin letters with A-Z in lower case. One run in 31, chosen by a checksum of document and
    run, loses a letter, as a source of misspellings. Counts are added up within a batch before they are shuffled.
    Null texts have no words; a null id counts as the text ``null``. Rows that repeat are counted as often.
    """
    import re

    letters = re.compile(_RUN)

    def run(columns):
        total = Counter()
        for doc, text in zip(columns["_id"], columns["_text"]):
            if not text:
                continue
            name = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
            # bytes.lower changes A-Z only
            for word, n in Counter(letters.findall(text.encode("utf-8", "replace").lower().decode("utf-8"))).items():
                if len(word) >= min_length:
                    h = zlib.crc32(word.encode(), name)
                    if h % MISSPELT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    total[word] += n
        return {"word": list(total), "n": list(total.values())}

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_columns(rows, run, struct("word string, n long"), 4096).groupBy("word").agg(F.sum("n").alias("n"))


def length_filters(vocabulary: DataFrame) -> dict:
    """{length: blocks x 8 words of 64 bits}: a blocked Bloom filter for each word length.

    Tasks set bits, which are merged by block before the driver gets them; blocks are bounded by MAX_BLOCKS.
    """
    import numpy as np

    sizes = {r["length"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    wanted = {n: max(1, -(-count * BITS_PER_WORD // (64 * BLOCK_WORDS))) for n, count in sizes.items()}
    scale = min(1.0, MAX_BLOCKS / max(1, sum(wanted.values())))
    blocks = {n: max(1, int(b * scale)) for n, b in wanted.items()}

    def run(columns):
        out = {"length": [], "slot": [], "bits": []}
        for n, _, words in _by_length(columns["word"]):
            block, bits = _places(_word_hash(_matrix(words)), blocks[n])
            slots = np.concatenate([block * BLOCK_WORDS + (b >> np.uint64(6)).astype(np.int64) for b in bits])
            values = np.concatenate([np.uint64(1) << (b & np.uint64(63)) for b in bits])
            order = np.argsort(slots, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(slots[order]) != 0])
            merged = np.bitwise_or.reduceat(values[order], starts)
            out["length"] += [n] * len(starts)
            out["slot"] += slots[order][starts].tolist()
            out["bits"] += merged.view(np.int64).tolist()
        return out

    set_bits = map_columns(vocabulary.select("word"), run, struct("length int, slot long, bits long"), 65536)
    merged = set_bits.groupBy("length", "slot").agg(F.bit_or("bits").alias("bits"))
    filters = {n: np.zeros(b * BLOCK_WORDS, np.uint64) for n, b in blocks.items()}
    table = merged.toArrow()  # at most 8 * MAX_BLOCKS rows
    length, slot, bits = (np.asarray(table.column(c)) for c in ("length", "slot", "bits"))
    for n in filters:
        here = length == n
        filters[n][slot[here]] = bits[here].astype(np.int64).view(np.uint64)
    return filters


def _passes(words_of, hashes):
    """Which hashes a filter may hold. One bit is looked at first, since most edits fail there."""
    import numpy as np

    block, bits = _places(hashes, len(words_of) // BLOCK_WORDS)
    left = np.arange(len(hashes))
    for b in bits:
        slot = block[left] * BLOCK_WORDS + (b[left] >> np.uint64(6)).astype(np.int64)
        left = left[(words_of[slot] >> (b[left] & np.uint64(63))) & np.uint64(1) == 1]
    return left


def _probe(words: list[str], letters, shorter, same):
    """(row, edited word) of the edits that pass: deletions in ``shorter``, greater replacements in ``same``."""
    import numpy as np

    codes = _matrix(words)
    rows, length = codes.shape
    at = np.arange(length, dtype=np.uint64)
    share = _letter_hash(at, codes)
    whole = np.bitwise_xor.reduce(share, axis=1)
    out_row, out_word = [], []
    if shorter is not None:
        # letters after the deleted one move one place down
        moved = _letter_hash(at[1:] - np.uint64(1), codes[:, 1:])
        tail = np.zeros((rows, length), np.uint64)
        tail[:, :-1] = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
        head = np.zeros((rows, length), np.uint64)
        head[:, 1:] = np.bitwise_xor.accumulate(share[:, :-1], axis=1)
        first = np.ones((rows, length), bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]  # either of two equal neighbours gives the same word
        r, p = np.nonzero(first)
        for i in _passes(shorter, (head ^ tail)[r, p]):
            out_row.append(r[i])
            out_word.append(words[r[i]][:p[i]] + words[r[i]][p[i] + 1:])
    for p in range(length):
        without = whole ^ share[:, p]
        r, c = np.nonzero(letters[None, :] > codes[:, p, None])
        for i in _passes(same, without[r] ^ _letter_hash(np.uint64(p), letters)[c]):
            out_row.append(r[i])
            out_word.append(words[r[i]][:p] + chr(letters[c[i]]) + words[r[i]][p + 1:])
    return out_row, out_word


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of (word, n) that differ by one inserted, deleted or
    replaced code point.

    ``vocabulary`` is read several times, so it should be a written table. Pairs are found from one side and returned
    from both. A word has at most its length times the number of letters near words, so no key is hot.
    """
    import numpy as np

    spark = vocabulary.sparkSession
    filters = {n: spark.sparkContext.broadcast(words) for n, words in length_filters(vocabulary).items()}
    # the letters in use: bounded by the letters that words are made of
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in used if r["c"]), np.uint32)

    def run(columns):
        out = {"word": [], "n": [], "edited": []}
        for length, at, words in _by_length(columns["word"]):
            step = max(1, 2_000_000 // (length * max(1, len(letters))))  # edits in memory at once
            for start in range(0, len(words), step):
                part = words[start:start + step]
                rows, edited = _probe(part, letters, filters[length - 1].value if length - 1 in filters else None, filters[length].value)
                out["word"] += [part[r] for r in rows]
                out["n"] += [columns["n"][at[start + r]] for r in rows]
                out["edited"] += edited
        return out

    rows = vocabulary.count()
    dealt = vocabulary.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_WORDS)), "word")
    possible = map_columns(dealt.select("word", "n"), run, struct("word string, n long, edited string"), 4096)
    listed = vocabulary.select(F.col("word").alias("edited"), F.col("n").alias("edited_n"))
    pairs = materialise(possible.join(listed, "edited"), "near-words")
    return pairs.select("word", F.col("edited").alias("near"), F.col("edited_n").alias("near_n")).unionByName(
        pairs.select(F.col("edited").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def follow(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root): where each ``word`` ends by going from word to ``form`` again and again.

    Each round doubles the steps taken. Links must not go round in a circle; forms do not, since each occurs more often.
    """
    at = materialise(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max_rounds):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(onward, "root", "left")
        if moved.filter("_next is not null").isEmpty():
            return at
        at = materialise(moved.select("word", F.coalesce("_next", "root").alias("root")), "forms")
    raise RuntimeError(f"forms do not end after {max_rounds} rounds")


def spelling_forms(words: DataFrame, ratio: int = 10, min_count: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of (word, n) with the spelling that it is a variant of.

    Of the words one edit away, the commonest is the form (ties: the first by code points) if it occurs at least
    ``ratio`` times as often; else form and form_n are null. The root is where following forms ends, the word itself
    without one. Rarer words than ``min_count`` do not count; rows that repeat a word are added up, null words left out.
    Other columns are not looked at. An empty table gives an empty result.
    """
    vocabulary = words.filter("word is not null and word <> ''").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    vocabulary = materialise(vocabulary, "vocabulary")
    commonest = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), commonest)
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    formed = materialise(joined.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "forms-of")
    roots = follow(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_forms`` of the words of documents."""
    return spelling_forms(document_words(docs, id_col, text_col))
