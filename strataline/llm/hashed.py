"""Logistic regression on hashed word and character n-grams.

Features of a text, in three blocks of ``2**BITS``: each distinct word (1 if present), the character 3- and
4-grams of its distinct words (share of the distinct words), and its word pairs (share of the pairs). Scores
are sums of what each word brings, so a task computes a word's part once, whatever the order of the n-grams.
"""

from __future__ import annotations

import math
from array import array
from typing import NamedTuple
from zlib import crc32

BITS = 17
_BLOCK = 1 << BITS
_SHARE = 8.0  # scale of the two blocks of shares
_STEP = 1 << 18  # entries of the training matrix that are widened at a time


def _grams(words: list[bytes]):
    """(slots, owners): the character 3- and 4-grams of the words, with their ends marked, and the place of the word
    that each belongs to; long words count in full."""
    import numpy as np

    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stops = np.cumsum(sizes)
    flat = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = stops[owner] - np.arange(len(flat))  # bytes from here to the end of the word
    slots, owners = [], []
    for n in (3, 4):
        at = np.flatnonzero(left >= n)
        code = flat[at]
        for i in range(1, n):
            code = code << np.uint64(8) | flat[at + i]
        slots.append(((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(slots), np.concatenate(owners)


class WordIndex(dict):
    """Numbers the distinct words of a task and keeps each one's hash and its part of the scores."""

    def __init__(self, heads=()):
        super().__init__()
        self.heads = heads  # weight arrays of 3 * 2**BITS floats
        self._forget()

    def _forget(self):
        self.clear()
        self.hashes = array("Q")
        self.parts = [(array("d"), array("d")) for _ in self.heads]

    def _add(self, words: list[bytes]):
        import numpy as np

        self.update(zip(words, range(len(self), len(self) + len(words))))
        hashes = array("Q", map(crc32, words))
        self.hashes.extend(hashes)
        if self.heads:
            own = np.frombuffer(hashes, np.uint64).astype(np.int64) & (_BLOCK - 1)
            slots, owners = _grams(words)
            for weights, (alone, shared) in zip(self.heads, self.parts):
                alone.frombytes(weights[own].astype(float).tobytes())
                shared.frombytes(np.bincount(owners, weights[slots + _BLOCK], len(words)).tobytes())

    def ids(self, words: list[bytes]):
        import numpy as np

        if len(self) > 300_000:  # bounds the memory of a task; nothing else depends on it
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            self._add(new)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def pairs(self, ids):
        """The slot of each word pair, without the block's offset."""
        import numpy as np

        h = np.frombuffer(self.hashes, np.uint64)[ids]
        return ((h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(7)).astype(np.int64) & (_BLOCK - 1)

    def scores(self, ids, distinct) -> list[float]:
        """The linear score of a text under every head, bias excluded; 0 for a text without words."""
        import numpy as np

        if not len(ids):
            return [0.0] * len(self.heads)
        pairs = self.pairs(ids) + 2 * _BLOCK
        out = []
        for weights, (alone, shared) in zip(self.heads, self.parts):
            score = np.frombuffer(alone)[distinct].sum() + _SHARE * np.frombuffer(shared)[distinct].mean()
            if len(pairs):
                score += _SHARE * weights[pairs].mean()
            out.append(float(score))
        return out


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Slots and values of a text, for training."""
    import numpy as np

    index = WordIndex()
    words = text.encode("utf-8").split() if text else []
    if not words:
        return [], []
    ids = index.ids(words)
    whole = np.unique(np.frombuffer(index.hashes, np.uint64).astype(np.int64) & (_BLOCK - 1))
    slots, values = [whole], [np.ones(len(whole))]
    shares = [(_grams(list(index))[0] + _BLOCK, len(index))]
    if len(ids) > 1:
        shares.append((index.pairs(ids) + 2 * _BLOCK, len(ids) - 1))
    for found, n in shares:
        slot, count = np.unique(found, return_counts=True)
        slots.append(slot)
        values.append(count * (_SHARE / n))
    return np.concatenate(slots).tolist(), np.concatenate(values).tolist()


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


class Head(NamedTuple):
    """Weights, and the two numbers that turn a score into a calibrated probability."""

    weights: object
    slope: float
    offset: float


def train(sizes, slot, value, targets, weights, held_out, rounds: int = 120, decay: float = 1e-4) -> Head:
    """Fit on the rows that are not held out and calibrate on those that are, by Platt scaling.

    ``sizes`` says how many of the slots and values belong to each row. ``targets`` lie in 0..1 (soft labels are allowed). If either part lacks one of the classes the head gives the
    weighted share of the targets for every text, one half without rows.
    """
    import numpy as np

    y, w, hold = (np.asarray(x, float) for x in (targets, weights, held_out))
    hold = hold > 0
    share = float((y * w).sum() / w.sum()) if len(y) and w.sum() > 0 else 0.5
    constant = Head(np.zeros(3 * _BLOCK, np.float32), 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if any(not (part & (side > 0.5)).any() for part in (hold, ~hold) for side in (y, 1 - y)):
        return constant
    count = len(y)
    slot, value = np.asarray(slot, np.int32), np.asarray(value, np.float32)  # the driver holds 12 bytes an entry
    row = np.repeat(np.arange(count, dtype=np.int32), sizes)
    used = _telling(slot, value, row, y, w * ~hold)
    place = np.full(3 * _BLOCK, -1, np.int32)
    place[used] = np.arange(len(used))
    some = place[slot] >= 0
    row, value, col = row[some].astype(np.intp), value[some].astype(float), place[slot[some]].astype(np.intp)
    fit = w * ~hold
    fit = fit * (y / max((fit * y).sum(), 1e-9) + (1 - y) / max((fit * (1 - y)).sum(), 1e-9)) / 2  # classes weigh alike
    coef, bias = np.zeros(len(used)), 0.0
    mean, square, bias_mean, bias_square = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * coef[col], count) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * fit
        grad = np.bincount(col, value * error[row], len(used)) + decay * coef
        rate = 0.1 * (1 - step / (rounds + 1))
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        bias_mean, bias_square = 0.9 * bias_mean + 0.1 * error.sum(), 0.99 * bias_square + 0.01 * error.sum() ** 2
        fix1, fix2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        coef = coef - rate * (mean / fix1) / (np.sqrt(square / fix2) + 1e-7)
        bias -= rate * (bias_mean / fix1) / (math.sqrt(bias_square / fix2) + 1e-7)
    score = np.bincount(row, value * coef[col], count)
    slope, offset = _platt(score[hold], y[hold], w[hold], bias)
    full = np.zeros(3 * _BLOCK, np.float32)
    full[used] = coef
    return Head(full, slope, offset)


def _telling(slot, value, row, y, w, least: float = 4.0, least_rows: int = 4):
    """Slots whose mean differs between the classes by ``least`` standard errors, in ``least_rows`` rows or more."""
    import numpy as np

    width = 3 * _BLOCK
    shares = [c / c.sum() for c in (w * y, w * (1 - y))]
    first, second, rows = np.zeros((2, width)), np.zeros((2, width)), np.zeros(width)
    for start in range(0, len(slot), _STEP):
        s, v, r = slot[start:start + _STEP], value[start:start + _STEP].astype(float), row[start:start + _STEP]
        for k, c in enumerate(shares):
            first[k] += np.bincount(s, v * c[r], width)
            second[k] += np.bincount(s, v * v * c[r], width)
        rows += np.bincount(s, (w > 0)[r], width)
    variance = sum(np.maximum(second[k] - first[k] * first[k], 0) * (c * c).sum() + 1e-9 for k, c in enumerate(shares))
    return np.flatnonzero((np.abs(first[0] - first[1]) >= least * np.sqrt(variance)) & (rows >= least_rows))


def _platt(score, y, w, bias: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out scores, by damped Newton steps.

    Targets are drawn in a little, so that a separable part has a finite curve.
    """
    import numpy as np

    w = w / w.mean()
    up, down = (w * y).sum(), (w * (1 - y)).sum()
    t = y * (up + 1) / (up + 2) + (1 - y) / (down + 2)
    scale = max(float(np.abs(score).max()), 1e-9)
    a, b, x = scale, bias, score / scale
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - t), w * p * (1 - p)
        ga, gb = (g * x).sum() + 1e-6 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 4, abs(db) / 4)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 0.0) / scale), float(b)
