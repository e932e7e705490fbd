"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a document's passage in up to ``floor(rate * m)`` edits. Cut into one
piece more than that, at least one piece is found unchanged. An Aho-Corasick automaton over the pieces finds the
exact hits in one pass over a text; around each, Myers' bit-parallel method works out the edit distance of the
item to the closest passage. The benchmark goes to the tasks in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .batches import map_columns, struct

#: Edits that are allowed for each character of an item.
ERROR_RATE = 0.08
#: Bytes of items in a block at most, on average; a block is collected, sent to the tasks and made an automaton.
BLOCK_BYTES = 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, with runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, rate: float) -> list[tuple[int, str]]:
    """Offset and text of error-budget-plus-one pieces that make up the item."""
    count = min(int(rate * len(item)) + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the passage of ``text`` that is closest to the pattern, the first of equally close ones.

    ``pattern_bits`` has a bit for each place of a character. Integers of any width are the bit vectors.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    get = pattern_bits.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        h_down = up & d
        h_up = down | ~(up | d) & full
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        down = h_up & d
        up = (h_down << 1 | ~(h_up | d)) & full
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """The pieces of some items as an automaton, and the search of texts for the items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for item, text in items:  # equal items are searched once
            by_text.setdefault(text, []).append(item)
        self.items = [(ids, text, int(rate * len(text))) for text, ids in by_text.items()]
        self.bits: list = [None] * len(self.items)
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, _) in enumerate(self.items):
            for offset, piece in pieces_of(text, rate):
                where.setdefault(piece, []).append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def search(self, text: str):
        """(item id, distance, start, stop) of every item within its budget; the closest passage of each, then the first."""
        if self.empty:
            return []
        diagonals: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for n, stop in places:
                diagonals.setdefault(n, set()).add(end + 1 - stop)
        found = []
        for n, starts in diagonals.items():
            ids, item, budget = self.items[n]
            at = text.find(item)
            if at >= 0:
                best = (0, at + len(item))
            else:
                best = self._closest(n, text, sorted(starts))
            if best is not None and best[0] <= budget:
                start = best[1] - len(item)
                found.extend((i, best[0], max(start, 0), best[1]) for i in ids)
        return found

    def _closest(self, n: int, text: str, starts: list[int]):
        _, item, budget = self.items[n]
        if not budget:
            return None
        if self.bits[n] is None:
            bits: dict[str, int] = {}
            for i, c in enumerate(item):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits[n] = bits
        best = None
        windows: list[list[int]] = []
        for s in starts:
            low, high = max(0, s - budget), min(len(text), s + len(item) + budget)
            if high - low < len(item) - budget:
                continue
            if windows and low <= windows[-1][1] and high - windows[-1][0] <= 4 * len(item):
                windows[-1][1] = high
            else:
                windows.append([low, high])
        for low, high in windows:
            distance, end = myers(self.bits[n], len(item), text[low:high])
            if best is None or distance < best[0]:
                best = (distance, low + end)
        return best


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): items within their error budget of a passage of a text.

    Texts and items are compared in lower case with white space collapsed; ``stop`` is where the closest passage
    ends in the normalised text and ``start`` lies an item's length before. Null and empty texts and items match
    nothing; short items have a budget of 0 and must occur as they are. Rows that repeat a doc_id or an item_id
    give a row each. All items are searched, in as many blocks as their bytes ask for; each block is a pass over all rows.
    """
    schema = struct("doc_id long, item_id long, distance int, start long, stop long")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and length(trim(text)) > 0")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        listed = sorted((r["item_id"], normalised(r["text"])) for r in part.collect())  # about block_bytes
        sent = spark.sparkContext.broadcast([(i, t) for i, t in listed if t])

        def run(columns, state=[], sent=sent):
            if not state:
                state.append(Matcher(sent.value, rate))
            result = {f.name: [] for f in schema}
            for doc, text in zip(columns["doc_id"], columns["text"]):
                if text:
                    for row in state[0].search(normalised(text)):
                        for f, v in zip(result, (doc, *row)):
                            result[f].append(v)
            return result

        matches = map_columns(rows, run, schema, 128)
        out = matches if out is None else out.unionByName(matches)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns; rows without an id stay."""
    leaked = benchmark_matches(docs, benchmark, rate).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
