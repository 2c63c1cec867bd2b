"""Documents as averages of hashed word and character n-gram vectors, with a softmax above.

Features of a text are its words, its pairs of neighbouring words (of equal ones also that
they are), and the runs of two to four characters in a word and its borders (one space on
each side), each hashed to one of ``buckets`` rows of a matrix, plus one end mark for each
text. A text's vector is the mean
of the rows of all its features; two output rows and a softmax tell the probability of
class 1. Both matrices are learned by plain stochastic gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Odd multipliers, which have inverses by 2^64: a run's hash does not depend on its place.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_KINDS = np.array([0x1F83D9ABFB41BD6B * (2 * i + 1) % (1 << 64) for i in range(8)], np.uint64)
_TWICE, _WORD, _WORDS, _END = 0, 5, 6, 7

# Characters that are hashed at once; a word is never cut.
_AT_ONCE = 1 << 18


def features(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in parts."""
    yield _bucket(_KINDS[_END : _END + 1], buckets)
    start, before = 0, None
    while start < len(text):
        end = start + _AT_ONCE
        if end < len(text):
            found = [at for at in (text.find(c, end) for c in " \t\n\v\f\r") if at >= 0]
            end = min(found, default=len(text))
        part, before = _part(text[start:end], before, buckets)
        yield part
        start = end


def _part(text: str, before: np.uint64 | None, buckets: int) -> tuple[np.ndarray, np.uint64 | None]:
    """Buckets of a part that is cut at white space, and the hash of its last word."""
    chars = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars[space] = 32
    found = []
    for n in (2, 3, 4):
        size = len(chars) - n + 1
        if size < 1:
            break
        run = np.zeros(size, np.uint64)
        whole = ~(space[:size] & space[1 : size + 1])
        for i in range(n):
            run = run * np.uint64(_STEP) + chars[i : i + size]
            if 0 < i < n - 1:
                whole &= ~space[i : i + size]
        found.append(_bucket((run[whole] + np.uint64(1)) * _KINDS[n], buckets))
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    firsts, lasts = edges[::2] + 1, edges[1::2] + 1
    if len(firsts):
        powers = np.full(len(chars), _STEP, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        backs = np.full(len(chars), _BACK, np.uint64)
        backs[0] = 1
        backs = np.cumprod(backs, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(1)) * powers, dtype=np.uint64)])
        words = (sums[lasts] - sums[firsts]) * backs[firsts]
        found.append(_bucket(words * _KINDS[_WORD], buckets))
        line = words if before is None else np.concatenate([np.array([before], np.uint64), words])
        found.append(_bucket((line[:-1] * _PAIR + line[1:]) * _KINDS[_WORDS], buckets))
        twice = int((line[:-1] == line[1:]).sum())
        found.append(np.repeat(_bucket(_KINDS[_TWICE : _TWICE + 1], buckets), twice))
        before = words[-1]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), before


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Scorer:
    """What is left of a model of two classes: how far each feature moves the odds, and the odds beforehand.

    The softmax of two outputs only takes their difference, and that of a mean of vectors is
    the mean of each vector's own.
    """

    moves: np.ndarray
    shift: float

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for part in features(text, len(self.moves)):
            total += float(self.moves[part].sum())
            n += len(part)
        return float(1 / (1 + np.exp(-np.clip(total / n + self.shift, -500, 500))))


def train(
    texts: list[str],
    classes: list[int],
    shift: float = 0.0,
    buckets: int = 1 << 17,
    dim: int = 16,
    epochs: int = 10,
    least_steps: int = 3000,
    rate: float = 5.0,
    seed: int = 12,
) -> Scorer:
    """Vectors and outputs learned one text at a time, in shuffled order, at a falling rate.

    Texts of both classes weigh the same in all; ``shift`` is added to the log odds after.
    All texts are gone through ``epochs`` times, few ones as often as makes ``least_steps``.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    known = []
    for text in texts:
        found, counts = np.unique(np.concatenate(list(features(text, buckets))), return_counts=True)
        known.append((found.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
    weight = [len(classes) / (2 * max(1, classes.count(c))) for c in (0, 1)]
    epochs = max(epochs, -(-least_steps // len(texts)))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            found, share = known[i]
            step = rate * weight[classes[i]] * (1 - done / steps)
            mean = share @ vectors[found]
            odds = np.exp(output @ mean - (output @ mean).max())
            error = -odds / odds.sum()
            error[classes[i]] += 1
            moved = error @ output
            moved /= max(1.0, float(np.sqrt(moved @ moved)))
            # The matrix of outputs is met by every text, a vector by few: it moves a tenth as far.
            output += np.float32(0.1 * min(step, rate)) * np.outer(error, mean)
            vectors[found] += np.float32(step) * share[:, None] * moved
            done += 1
    return Scorer((vectors @ (output[1] - output[0])).astype(np.float64), shift)
