"""Word shingles of texts as 64-bit hashes, and their min-hash labels."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hash of each word met; emptied by ``trim`` when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13, A-Z in lower case."""
    return text.encode().lower().split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole, if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    short = n < width
    width = min(n, width)
    out = np.full(n - width + 1, n if short else 0, np.uint64)
    for i in range(width):
        out *= _STEP
        out += each[i : n - width + 1 + i]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def hash_functions(n: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, rng.integers(0, 2**63, n, dtype=np.uint64)


def min_labels(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each function a 16-bit label of the shingle it sends lowest."""
    factor, offset = functions[0][:, None], functions[1][:, None]
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        sent = factor * shingles[None, i : i + 512]
        sent += offset
        np.minimum(least, sent.min(axis=1), out=least)
    return ((least * _MIX) >> np.uint64(48)).astype(">u2")
