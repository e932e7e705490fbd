"""Conversation prefix trie: every distinct sequence of first turns, with what its subtree holds.

Conversations become sequences of turn ids (two 64-bit hashes of role and text). They are sorted and dealt to range
shards. A shard reads its rows in blocks; a block is a padded matrix of dense turn ids, put in order by a lexsort.
OR-accumulated masks of the columns that change from row to row mark where nodes start at each depth, and reduceat
adds up every depth. Nodes of a block's first or last row may go on in the block before or after it: these boundary nodes
are written as parts, which joins recombine, with the sums of their subtrees.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .batches import struct

#: Cells of a block's matrix at most (a longer conversation is a block of its own). Boundary nodes are two paths a block.
BLOCK_CELLS = 1 << 20
#: Copies of each boundary node when its children look it up, since a root has very many.
SALTS = 32
#: Member ids in one row, where a boundary node's ids travel to be hashed.
IDS_ROWS = 4096

_EMPTY = hashlib.sha256(b"").hexdigest()
#: What a shard writes. Kind 0: a finished node. Kind 1: a boundary node's part on one path of one block. Kind 2: ids that
#: end at a boundary node.
_SHARD = struct("kind int, path long, depth int, node string, parent string, conv_id long, parent_conv_id long, n_convs long, "
                "n_children long, n_leaves long, saved long, own long, ends string")


def turn_sequences(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, turns): an array<struct<a, b, size>> for each conversation, in the order of turns.

    ``a`` and ``b`` are hashes of role and text, ``size`` is the text's length. A null turn number comes first; equal
    numbers go by role and then by hash. Null roles and texts count as empty. Rows that repeat are turns of their own,
    rows with a null id belong to no conversation. Only hashes are shuffled, not texts. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"),
                    F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("bigint").alias("size"))
    own = rows.select(F.col(id_col).cast("bigint").alias("conv_id"), turn.alias("_turn")).filter("conv_id is not null")
    hundred = (F.col("conv_id") - F.pmod("conv_id", F.lit(100))).alias("_hundred")
    # dealt by hundreds, so that what needs a hundred's first conversation finds it where it is
    grouped = own.withColumn("_hundred", hundred).repartition("_hundred").groupBy("_hundred", "conv_id").agg(
        F.sort_array(F.collect_list("_turn")).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size"))))


def with_shared_starts(sequences: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first h turns of the hundred's first conversation, then their own after their first h.

    h is a checksum of the id, 0 to 5. Without such a first conversation nothing replaces the first h turns. No shuffle
    is added to that of ``turn_sequences``.
    """
    hundred = W.partitionBy("_hundred")
    first = F.max(F.when(F.col("conv_id") == F.col("_hundred"), F.slice("turns", 1, 5))).over(hundred)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    none = F.array().cast("array<struct<a:bigint,b:bigint,size:bigint>>")
    rebuilt = F.concat(F.slice(F.coalesce(F.col("_first"), none), F.lit(1), F.col("_h")),
                       F.slice("turns", F.col("_h") + 1, F.size("turns")))
    return sequences.withColumn("_first", first).withColumn("_h", h).select("conv_id", rebuilt.alias("turns"))


def _padded(lengths, a, b, size):
    """The padded matrices of dense turn ids (0 pads) and of text sizes."""
    import numpy as np

    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    dense = np.empty(len(order), np.int64)
    dense[order] = np.cumsum(new)
    inside = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
    ids, sizes = np.zeros(inside.shape, np.int64), np.zeros(inside.shape, np.int64)
    ids[inside], sizes[inside] = dense, size
    return ids, sizes


def _path_names(turns):
    """Names of the nodes on a path from the root: a digest of all turns so far."""
    names = ["root"]
    for a, b in turns:
        names.append(hashlib.sha256(f"{names[-1]}/{a}/{b}".encode()).hexdigest()[:32])
    return names


def _block_nodes(number: int, convs, lengths, a, b, size):
    """The rows of kind 0, 1 and 2 (see _SHARD) of one block, as dicts of columns.

    ``a``, ``b`` and ``size`` hold the turns of all rows one after another. The block's rows lie between those of the
    blocks before and after it; inside they may have any order.
    """
    import numpy as np

    ids, sizes = _padded(lengths, a, b, size)
    order = np.lexsort((convs, *ids.T[::-1]))
    start_of = np.r_[0, np.cumsum(lengths)]
    ids, sizes, convs, lengths = ids[order], sizes[order], convs[order], lengths[order]
    rows, width = ids.shape
    changed = np.zeros((rows, width + 1), bool)  # a row differs from the one before it in one of the first d turns
    changed[1:, 1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
    paths = []
    for row in (0, rows - 1):
        at = slice(start_of[order[row]], start_of[order[row]] + lengths[row])
        paths.append(_path_names(zip(a[at].tolist(), b[at].tolist())))
    out = []
    below = None
    for d in range(width, -1, -1):
        alive = np.flatnonzero(lengths >= d)
        new = changed[alive, d]
        new[0] = True
        starts = np.flatnonzero(new)
        count = len(starts)
        n = np.add.reduceat(np.ones(len(alive), np.int64), starts)
        least = np.minimum.reduceat(convs[alive], starts)
        node_of = np.empty(rows, np.int64)
        node_of[alive] = np.cumsum(new) - 1
        first = alive[starts]
        children, leaves, saved = (np.zeros(count, np.int64) for _ in range(3))
        on_path = [node_of[row] if lengths[row] >= d else -1 for row in (0, rows - 1)]
        if below is not None:
            up = node_of[below["row"]]
            done = below["done"]
            np.add.at(children, up[done], 1)
            np.add.at(leaves, up[done], below["n_leaves"][done])
            np.add.at(saved, up[done], below["saved"][done])
            parent_name = np.full(len(up), None, object)
            for path, node in zip(paths, on_path):
                if node >= 0:
                    parent_name[up == node] = path[d]
            out.append({"kind": 0, "depth": d + 1, "parent": parent_name[done], "parent_conv_id": least[up][done], "conv_id": below["least"][done],
                        **{c: below[c][done] for c in ("n_convs", "n_children", "n_leaves", "saved", "ends")}})
        own = sizes[first, d - 1] if d else np.zeros(count, np.int64)
        # ids of rows that end here come first in each node, in ascending order
        n_ending = np.add.reduceat((lengths[alive] == d).astype(np.int64), starts)
        ends = np.full(count, _EMPTY, object)
        done = np.ones(count, bool)
        done[[k for k in on_path if k >= 0]] = False
        for k in np.flatnonzero(done & (n_ending > 0)):
            members = convs[first[k]:first[k] + n_ending[k]]
            ends[k] = hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest()
        for side, k in enumerate(on_path):
            if k < 0:
                continue
            path = paths[side]
            part = {"kind": 1, "path": 2 * number + side, "depth": d, "node": path[d], "parent": path[d - 1] if d else None}
            if side and on_path[0] == k:  # the first path has counted it
                out.append({**part, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "own": int(own[k])})
                continue
            out.append({**part, "conv_id": int(least[k]), "n_convs": int(n[k]), "n_children": int(children[k]),
                        "n_leaves": int(leaves[k]), "saved": int(saved[k]), "own": int(own[k])})
            members = convs[first[k]:first[k] + n_ending[k]]
            for start in range(0, len(members), IDS_ROWS):
                chunk = members[start:start + IDS_ROWS].tolist()
                out.append({"kind": 2, "node": path[d], "conv_id": chunk[0], "ends": ",".join(map(str, chunk))})
        below = {"row": first, "done": done, "least": least, "n_convs": n, "n_children": children, "ends": ends,
                 "n_leaves": np.where(children == 0, 1, leaves), "saved": saved + (n - 1) * own}
    return out


def _blocks(batches):
    """(convs, lengths, a, b, size) of as many rows as make a matrix of BLOCK_CELLS."""
    import numpy as np

    held, count, longest = [], 0, 0

    def joined():
        return tuple(np.concatenate([h[i] for h in held]) for i in range(5))

    for batch in batches:
        convs = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        turns = lists.flatten()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        fields = [turns.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
        cut = np.r_[0, np.cumsum(lengths)]
        start = 0
        while start < len(convs):
            room = np.arange(1, len(convs) - start + 1) + count
            deepest = np.maximum(np.maximum.accumulate(lengths[start:]), longest)
            fits = int(np.searchsorted(room * deepest, BLOCK_CELLS, side="right"))
            if fits == 0 and count:
                yield joined()
                held, count, longest = [], 0, 0
                continue
            stop = start + max(fits, 1)
            held.append((convs[start:stop], lengths[start:stop], *[f[cut[start]:cut[stop]] for f in fields]))
            count, longest = count + stop - start, max(longest, int(lengths[start:stop].max()))
            start = stop
    if held:
        yield joined()


def _shard_nodes(batches):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_SHARD)
    number = TaskContext.get().partitionId() << 32
    for block in _blocks(batches):
        pieces = _block_nodes(number, *block)
        number += 1
        lengths = [max([len(v) for v in p.values() if isinstance(v, np.ndarray)], default=1) for p in pieces]
        columns = []
        for field in schema:
            values = []
            for p, n in zip(pieces, lengths):
                v = p.get(field.name)
                values.extend(v.tolist() if isinstance(v, np.ndarray) else [v] * n)
            columns.append(pa.array(values, type=field.type))
        table = pa.RecordBatch.from_arrays(columns, schema=schema)
        for start in range(0, table.num_rows, 65536):
            yield table.slice(start, 65536)


def _hash_ends(batches):
    """The digest of each node's ids, whose rows come one after another in order. Only a hash is held."""
    import pyarrow as pa

    node, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(state.hexdigest())
                node, state = name, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends"])


def _recombined(shards: DataFrame) -> DataFrame:
    """Boundary nodes put together from their parts; what lies between two paths of a block is in the parts already."""
    parts = shards.filter("kind = 1")
    whole = parts.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("own").alias("own"), F.min("path").alias("owner"))
    of_parent = whole.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_more"))
    whole = whole.join(of_parent, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    whole = materialise(whole.drop("_more"), "boundary-nodes")
    # what a node and its finished children bring counts on one path; sums from a path's end upwards, added over paths,
    # make a subtree's sum
    share = whole.select("node", "owner", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("_leaf"),
                         (F.col("saved") + (F.col("n_convs") - 1) * F.col("own")).alias("_saved"))
    upwards = W.partitionBy("path").orderBy(F.desc("depth"))
    on_paths = parts.select("path", "depth", "node").join(share, "node")
    owned = F.col("path") == F.col("owner")
    sums = on_paths.select("node", *[F.sum(F.when(owned, F.col(c)).otherwise(0)).over(upwards).alias(c) for c in ("_leaf", "_saved")])
    sums = sums.groupBy("node").agg(F.sum("_leaf").alias("n_leaves"), F.sum("_saved").alias("saved"))
    ids = shards.filter("kind = 2").select("node", "ends", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ids.select("node", "ends").mapInArrow(_hash_ends, "node string, ends string")
    return materialise(whole.drop("n_leaves", "saved").join(sums, "node").join(ends, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved",
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends")), "boundary")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``sequences`` has a row (conv_id, turns) for each conversation, see ``turn_sequences``. A node is a distinct
    sequence of first turns, its members the conversations that start with it, conv_id the smallest of them. Saved
    tokens are the characters that sharing saves in its subtree: every text counted once less than it occurs.
    ends_sha256 is the digest of the ids of conversations that end at the node, ascending, joined by commas.

    A conversation without turns is a member of the root only. An empty table has no nodes. Copies of a conversation
    are told apart by id when rows are dealt to shards, so a third of all rows may be equal. Ids that end at
    one boundary node are hashed in one pass, in chunks, since a digest is sequential; they are never held together.
    """
    dealt = sequences.select("conv_id", "turns").repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    shards = materialise(dealt.mapInArrow(_shard_nodes, _SHARD), "trie-shards")
    boundary = _recombined(shards)
    inner = shards.filter("kind = 0").withColumn("_salt", F.when(F.col("parent").isNotNull(), F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS))))
    names = boundary.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"))
    salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    counts = ["n_convs", "n_children", "n_leaves", "saved", "ends"]
    open_parent = inner.filter("parent is not null").join(salted, ["parent", "_salt"]).select("conv_id", "depth", F.col("_parent_conv").alias("parent_conv_id"), *counts)
    done_parent = inner.filter("parent is null").select("conv_id", "depth", "parent_conv_id", *counts)
    at_boundary = boundary.join(names, "parent", "left").select("conv_id", "depth", F.col("_parent_conv").alias("parent_conv_id"), *counts)
    nodes = done_parent.unionByName(open_parent).unionByName(at_boundary)
    return nodes.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The prefix trie of conversations that begin like the first one of their hundred, see ``with_shared_starts``."""
    return prefix_trie(with_shared_starts(turn_sequences(rows)))
