"""Variable-order byte context trees with escapes, for several classes at once.

Prediction by partial matching: the probability of a byte is that of the longest context
of at most ``order`` bytes that was met in training, ``n / (total + kinds)``; if the byte
never followed that context, an escape of ``kinds / (total + kinds)`` is paid and the
context is shortened by its oldest byte; after the empty context all bytes are alike.
Statistics are frozen, so the code length of a byte depends on it and its ``order``
predecessors only. Each tree level is therefore a table: of every string of context and
byte met in any class, the code length in each class, escapes included; and of every
context, its escape in each class. A string that is in no table costs the escapes of its
context and is looked up one byte shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Row numbers of distinct 64-bit keys, found by open addressing."""

    def __init__(self, keys: np.ndarray):
        # At most a quarter of the slots is taken: few keys are not where they are looked for first.
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = keys.astype(np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(self.keys)
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]
            placed = self.rows[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def __getstate__(self) -> np.ndarray:
        """The keys alone: a table travels without its slots."""
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 of one that is not there."""
        slot = self._slot(keys)
        found = self.rows[slot]
        again = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else found[:0]
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            now = found[again] = self.rows[slot[again]]
            again = again[(now >= 0) & (self.keys[now] != keys[again])]
        return found


@dataclass
class Trees:
    """Level ``d`` has the strings of ``d`` context bytes and one more."""

    order: int
    n_classes: int
    strings: list[Table]
    costs: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]

    def code_lengths(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each class.

        ``text`` holds the bytes of all, each preceded by ``order`` bytes of padding
        (see ``padded``); ``starts`` is where each one's padding begins.
        """
        sums = np.zeros((len(starts), self.n_classes))
        block = max(4096, (1 << 20) // self.n_classes)
        ends = np.r_[starts[1:], len(text)]
        for low in range(0, len(text), block):
            high = min(len(text), low + block)
            first = np.searchsorted(ends, low, side="right")
            last = np.searchsorted(starts, high, side="left")
            # The bytes of this block that are text, not padding.
            is_text = np.ones(high - low, bool)
            for j in range(self.order):
                at = starts[first:last] + j - low
                is_text[at[(at >= 0) & (at < high - low)]] = False
            cost = self._costs(text, low, high)
            cost[~is_text] = 0
            edges = np.maximum(starts[first:last] - low, 0)
            sums[first:last] += np.add.reduceat(cost, edges, axis=0, dtype=np.float64)
        return sums

    def _costs(self, text: np.ndarray, low: int, high: int) -> np.ndarray:
        keys = strings_of(text, low, high, self.order)
        cost = np.zeros((high - low, self.n_classes), np.float32)
        left = np.arange(high - low)
        for d in range(self.order, -1, -1):
            row = self.strings[d].find(keys)
            hit = row >= 0
            cost[left[hit]] += self.costs[d][row[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return cost
            row = self.contexts[d].find(keys >> np.uint64(8))
            known = row >= 0
            cost[left[known]] += self.escapes[d][row[known]]
            keys = keys & np.uint64((1 << (8 * d)) - 1) if d else keys
        cost[left] += 8
        return cost


def padded(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` line breaks, and where each begins."""
    pad = b"\n" * order
    sizes = np.array([len(p) + order for p in parts], np.int64)
    text = np.frombuffer(pad + pad.join(parts), np.uint8) if parts else np.zeros(0, np.uint8)
    return text, np.cumsum(sizes) - sizes


def strings_of(text: np.ndarray, low: int, high: int, order: int) -> np.ndarray:
    """The ``order + 1`` bytes that end at each of the positions, as one number."""
    keys = np.zeros(high - low, np.uint64)
    for back in range(order, -1, -1):
        keys <<= np.uint64(8)
        at = low - back
        take = text[max(0, at) : high - back]
        keys[max(0, -at) :] |= take.astype(np.uint64)
    return keys


def count_strings(parts: Iterator[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of ``order + 1`` bytes that end in a text, and how often."""
    held = list(parts)
    text, starts = padded(held, order)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = strings_of(text, 0, len(text), order)
    is_text = np.ones(len(text), bool)
    for j in range(order):
        is_text[starts + j] = False
    return np.unique(keys[is_text], return_counts=True)


def build(counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> Trees:
    """The trees of each class from its counts of strings of ``order + 1`` bytes."""
    n_classes = len(counts)
    trees = Trees(order, n_classes, [], [], [], [])
    below: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(order + 1):
        keep = np.uint64((1 << (8 * (d + 1))) - 1)
        strings = np.unique(np.concatenate([k & keep for k, _ in counts]))
        n = np.zeros((len(strings), n_classes))
        for c, (keys, times) in enumerate(counts):
            np.add.at(n[:, c], np.searchsorted(strings, keys & keep), times)
        contexts, member = np.unique(strings >> np.uint64(8), return_inverse=True)
        total = np.zeros((len(contexts), n_classes))
        kinds = np.zeros((len(contexts), n_classes))
        np.add.at(total, member, n)
        np.add.at(kinds, member, n > 0)
        met = total > 0
        escape = np.where(met, np.log2((total + kinds) / np.where(met, kinds, 1), where=met, out=np.zeros_like(total)), 0)
        if below is None:
            shorter = np.full((len(strings), n_classes), 8.0)
        else:
            shorter = below[1][np.searchsorted(below[0], strings & np.uint64((1 << (8 * d)) - 1))]
        bits = np.log2((total + kinds)[member] / np.where(n > 0, n, 1), where=n > 0, out=np.zeros_like(n))
        cost = np.where(n > 0, bits, escape[member] + shorter)
        below = (strings, cost)
        trees.strings.append(Table(strings))
        trees.costs.append(cost.astype(np.float32))
        trees.contexts.append(Table(contexts))
        trees.escapes.append(escape.astype(np.float32))
    return trees
