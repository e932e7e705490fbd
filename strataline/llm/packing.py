"""Best-fit packing of tokenized documents with a swap-based local search.

Tokens of a document are cut from its end into pieces of the capacity, so only the first piece may be shorter.
Whole pieces fill a sequence alone. The rest is packed by best fit, longest first, in independent shards, and
then improved by local search: moves, one-for-one and two-for-one exchanges between underfull sequences raise
the sum of squared fills until sequences run empty. What stays underfull in the shards is packed once more,
in fewer shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import map_columns, struct

#: Pieces that a shard packs at most on average; one task holds a shard's ids and lengths only.
SHARD_PIECES = 20_000
#: Trials of the local search for each underfull sequence.
SEARCH_PARTNERS = 48


#: Fixed value: how a byte-level pre-tokenizer cuts a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(tokenizer):
    """A faster encoder with the same ids for a plain byte-level BPE whose ids follow its merges, else None."""
    import json

    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and spec["normalizer"] is None and before.get("type") == "ByteLevel"
             and before.get("use_regex") and not before.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not plain:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    special = set(tokenizer.get_added_tokens_decoder())
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(tokenizer_path: str):
    """A function from text to the ids that ``Tokenizer.from_file(path).encode`` gives, as little-endian bytes.

    A single space between two non-spaces always starts a new piece of the byte-level pre-tokenizer, so a text
    is cut there and each distinct word is encoded once. Texts with other runs of white space are encoded
    whole; texts with an added token in them, and tokenizers of another kind, go through the tokenizer itself.
    """
    import os
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    ranked = _ranked(tokenizer)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    class Words(dict):
        """Ids of a word with a space before it."""

        def __missing__(self, word):
            if not word or word[0].isspace() or word[-1].isspace():
                raise LookupError
            self[word] = ids = array("I", ranked.encode_ordinary(" " + word)).tobytes()
            return ids

    words = Words()

    def encode(text: str) -> bytes:
        if ranked is None or any(s in text for s in special):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise LookupError
            out = array("I", ranked.encode_ordinary(first)).tobytes() + b"".join(map(words.__getitem__, rest))
        except LookupError:
            out = array("I", ranked.encode_ordinary(text)).tobytes()
        if len(words) > 500_000:
            words.clear()
        return out

    return encode


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = 1024,
                 end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and its end id, cut into pieces.

    ``tokenizer_path`` must be readable on the executors. A null text counts as empty: one piece with the end id.
    Rows that repeat an id are pieces of their own. Other columns are not looked at.
    """
    schema = struct("doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids ints" if with_ids else ""))

    def run(columns, encode=[]):
        import zlib

        import numpy as np

        if not encode:
            encode.append(_encoder(tokenizer_path))
        out = {f.name: [] for f in schema}
        for doc, text in zip(columns["_id"], columns["_text"]):
            raw = (encode[0](text) if text else b"") + end_id.to_bytes(4, "little")
            total = len(raw) // 4
            start, length, piece = 0, total % capacity or capacity, 0
            while start < total:
                cut = raw[4 * start:4 * (start + length)]
                out["doc_id"].append(doc)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(cut))
                if with_ids:
                    out["ids"].append(np.frombuffer(cut, "<u4").astype(np.int32))
                start, length, piece = start + length, capacity, piece + 1
        return out

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_columns(rows, run, schema, 64)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that takes it."""
    by_room = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins


def swap_search(bins: list[list[int]], lengths: list[int], capacity: int, partners: int = SEARCH_PARTNERS,
                sweeps: int = 8) -> list[list[int]]:
    """Local search over the underfull bins; returns the bins that are not empty.

    In a sweep each bin, the emptiest first, is the donor once. Against each of the ``partners`` fullest bins with
    room it tries a move, a one-for-one and a two-for-one exchange; what makes the fuller bin fullest is done,
    which raises the sum of squared fills. Sweeps end when one changes nothing, or after ``sweeps``.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(sweeps):
        changed = False
        waiting = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        while len(waiting) > 1:
            donor = waiting.pop(0)
            for b in waiting[:-partners - 1:-1]:
                if not bins[donor]:
                    break
                give, take = _exchange(bins[donor], bins[b], lengths, capacity - fill[b])
                if give:
                    gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                    bins[b] = [i for i in bins[b] if i not in take] + give
                    bins[donor] = [i for i in bins[donor] if i not in give] + take
                    fill[b] += gain
                    fill[donor] -= gain
                    changed = True
            waiting = sorted((b for b in waiting if fill[b] < capacity), key=lambda b: fill[b]) if changed else waiting
        if not changed:
            break
    return [b for b in bins if b]


def _exchange(donor: list[int], other: list[int], lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """What ``donor`` gives and takes so that ``other`` grows by the most, at most ``room``."""
    best, give, take = 0, [], []
    for i in donor:
        if best < lengths[i] <= room:
            best, give, take = lengths[i], [i], []
    singles = {}
    for j in other:
        singles.setdefault(lengths[j], j)
    ordered = sorted(donor, key=lambda i: lengths[i])
    for size, j in singles.items():
        for i in ordered:
            gain = lengths[i] - size
            if gain > room:
                break
            if gain > best:
                best, give, take = gain, [i], [j]
        for x, i in enumerate(ordered):
            for k in ordered[x + 1:]:
                gain = lengths[i] + lengths[k] - size
                if gain > room:
                    break
                if gain > best:
                    best, give, take = gain, [i, k], [j]
        if best == room:
            break
    return give, take


def _pack(pieces: DataFrame, shards: int, round_no: int, capacity: int) -> DataFrame:
    """(doc_id, piece, row, sequence_id, offset, fill): ``pieces`` packed in ``shards`` independent shards."""
    schema = struct("doc_id long, piece int, row long, length long, sequence_id long, offset long, fill long")

    def pack(keys, table):
        import pyarrow as pa

        t = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = t.column("length").to_pylist()
        bins = swap_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        base = (round_no << 60) | (keys[0].as_py() << 32)
        for n, b in enumerate(bins):
            total, at = sum(lengths[i] for i in b), 0
            for i in b:
                sequence[i], offset[i], fill[i] = base + n, at, total
                at += lengths[i]
        columns = {f.name: t.column(f.name) for f in schema if f.name in t.column_names}
        columns |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "fill": pa.array(fill, pa.int64())}
        return pa.table([columns[f.name] for f in schema], names=schema.names)

    shard = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards))
    keyed = pieces.select("doc_id", "piece", "row", "length", shard.alias("shard"))
    return keyed.groupBy("shard").applyInArrow(pack, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 1024, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece once, each sequence gapless from 0 and within ``capacity``.

    ``pieces`` has doc_id, piece and length (at most ``capacity``) and is read more than once, so pass a written
    table. Equal rows are told apart by a number of their own. Sequence ids are any numbers.
    """
    wide = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = (wide.filter(F.col("length") == capacity)
             .select("doc_id", "piece", "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    loose = wide.filter(F.col("length") < capacity).select("doc_id", "piece", "row", "length")
    shards = max(1, -(-loose.count() // shard_pieces))
    placed = materialise(_pack(loose, shards, 1, capacity), "packed")
    full = placed.filter(F.col("fill") * 64 >= capacity * 63)
    parts = full
    if shards > 1:
        rest = placed.filter(F.col("fill") * 64 < capacity * 63).select("doc_id", "piece", "row", "length")
        again = max(1, -(-rest.count() // shard_pieces))
        parts = full.unionByName(materialise(_pack(rest, again, 2, capacity), "packed"))
    else:
        parts = placed
    places = whole.unionByName(parts.select(*whole.columns)).select("row", "sequence_id", "offset")
    return wide.join(places, "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): all documents in sequences."""
    return pack_pieces(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id, with_ids), capacity)
