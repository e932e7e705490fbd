"""The prefix trie of conversations by plain Python, for comparison."""

import hashlib
import zlib
from collections import defaultdict


def brute_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, as the query returns them."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append((c, len(rebuilt)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_saved + sum(saved[c] for c in children[node])
    least = {node: min(c for c, _ in m) for node, m in members.items()}
    return {(least[node], len(node), least[node[:-1]] if node else None, len(m), len(children[node]), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(c for c, n in m if n == len(node)))).encode()).hexdigest())
            for node, m in members.items()}
