"""Prediction by partial matching over bytes, pretrained on the corpus, with vectorised scoring.

The byte-context trie holds, for every order o, the grams (context of o bytes, next byte)
with their counts. A context gives a symbol seen after it n times of t the probability
(n - 1/2) / t; the rest is its escape. After an escape the next shorter context is asked, with
the symbols that the longer one knows excluded: its distribution is renormalised over the
other symbols. As the symbols after a context are known when the model is made, exclusion and
escape make one factor for each context, and a text's code length is a sum of look-ups: for
each byte the longest gram in the trie, and the escapes of the contexts above it.

A gram of up to 8 bytes is one unsigned 64-bit number, so keys are exact.
"""

from __future__ import annotations

import numpy as np

EMPTY = np.uint64(0)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """The number of the `width` bytes that end at each position from width - 1 on."""
    n = len(data) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width):
        out <<= np.uint64(8)
        out |= data[j : j + n]
    return out


class Table:
    """An open-addressing map from unsigned 64-bit keys to floats, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        keys = keys + np.uint64(1)  # 0 marks an empty place
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == EMPTY
            mine = left[free]
            self.keys[at[mine]] = keys[mine]  # of several at one place the last stays
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 where it is not)."""
        keys = keys + np.uint64(1)
        at = self.home(keys)
        held = self.keys[at]
        hit = held == keys
        out = self.values[at]
        pending = np.flatnonzero(~hit & (held != EMPTY))
        while len(pending):
            at[pending] = (at[pending] + 1) & self.mask
            held = self.keys[at[pending]]
            found = held == keys[pending]
            hit[pending[found]] = True
            out[pending[found]] = self.values[at[pending[found]]]
            pending = pending[~found & (held != EMPTY)]
        out[~hit] = 0
        return hit, out


class Model:
    """grams[o]: (keys, counts, totals) of the grams of order o that the trie holds; totals: how often their contexts occur in all."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.grams, self.escapes = [], []
        for order, (keys, counts, totals) in enumerate(grams):
            p = (counts - 0.5) / totals
            contexts, which = np.unique(keys >> np.uint64(8), return_inverse=True)
            known = np.bincount(which, p, len(contexts))
            below = keys & np.uint64((1 << (8 * order)) - 1)
            lower = np.bincount(which, 10.0 ** self.log10(below, order - 1), len(contexts))  # the shorter context's share of these symbols
            escape = np.log10(np.clip(1 - known, 1e-12, None)) - np.log10(np.clip(1 - lower, 1e-12, None))
            self.grams.append(Table(keys, np.log10(p)))
            self.escapes.append(Table(contexts, escape))

    def log10(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Of each gram of this order: the last byte's log10 probability after the bytes before it."""
        out = np.zeros(len(keys), np.float64)
        at = np.arange(len(keys))
        for o in range(order, -1, -1):
            own = keys if o == 7 else keys & np.uint64((1 << (8 * (o + 1))) - 1)
            hit, value = self.grams[o].find(own)
            if len(at) == len(out) and o == order:
                out += value
            else:
                out[at] += value
            miss = np.flatnonzero(~hit)
            if not len(miss):
                return out
            at, keys = at[miss], own[miss]
            out[at] += self.escapes[o].find(keys >> np.uint64(8))[1]
        out[at] -= np.log10(256)
        return out

    @property
    def order(self) -> int:
        return len(self.grams) - 1


def framed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array, each after `order` line feeds and ended by one; the ends of what is scored of each."""
    pad = b"\n" * order
    data = np.frombuffer(b"".join([pad + t + b"\n" for t in texts]), np.uint8)
    ends = np.cumsum(np.array([order + len(t) + 1 for t in texts], np.int64))
    return data, ends


def sums(log10, k: int, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text and its end; log10: of an array of grams of order k."""
    data, ends = framed(texts, k)
    keys = rolling(data, k + 1)
    cost = np.zeros(len(data), np.float64)
    for i in range(0, len(keys), 1 << 18):
        cost[k + i : k + i + (1 << 18)] = log10(keys[i : i + (1 << 18)])
    starts = np.concatenate([[0], ends[:-1]])
    total = np.concatenate([[0.0], np.cumsum(cost)])
    return total[ends] - total[np.minimum(starts + k, ends)]


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text and its end."""
    return sums(lambda keys: model.log10(keys, model.order), model.order, texts)


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the highest order with their counts."""
    data, ends = framed(texts, order)
    keys = rolling(data, order + 1)
    inside = np.ones(len(keys), bool)  # a gram must not reach over the next text's line feeds
    for e in ends[:-1]:
        inside[e - order : e] = False
    return np.unique(keys[inside], return_counts=True)
