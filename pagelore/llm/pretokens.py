"""Texts cut into pre-tokens that a byte-level BPE tokenizer encodes independently.

The tokenizer's own pattern never lets a token run across a space that a non-space
follows, so a text may be cut before each such space, and its ids are those of its cuts.
A cut is kept as a key: without its leading space where it has just that one, else as
it is with a space appended. Keys of the first kind hold no space, so none is ambiguous.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

_GAP = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")


def keys(text: str, specials: tuple[str, ...]) -> list[str]:
    """The keys of ``text`` in order; ``specials`` are the tokenizer's added tokens."""
    for special in specials:
        if special in text:
            found = []
            for i, part in enumerate(text.split(special)):
                if i:
                    found.append(special + " ")
                found += keys(part, tuple(s for s in specials if s != special))
            return found
    if not text:
        return []
    if _GAP.search(text) is None:
        parts = text.split(" ")
        parts[0] += " "
        return parts
    return [
        cut[1:] if len(cut) > 1 and cut[0] == " " and " " not in cut[1:] else cut + " "
        for cut in _CUT.split(text)
        if cut
    ]


# A word of Latin letters that something else than a letter follows: a token always ends between them.
_WORD = re.compile("[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]+(?=[\\x00-@\\[-`{-\\x7f])")


def halves(key: str) -> tuple[str, ...]:
    """The keys of a word and of what follows it, where a token surely ends between; else the key itself.

    There are far fewer distinct words than words with their punctuation.
    """
    found = None if key.endswith(" ") else _WORD.match(key)
    if found is None:
        return (key,)
    return found[0], key[found.end() :] + " "


def special_tokens(path: str) -> tuple[str, ...]:
    """The added tokens of a byte-level BPE tokenizer; an error if its file is no such thing."""
    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    pattern = about.get("pre_tokenizer") or {}
    added = about.get("added_tokens") or []
    if about.get("normalizer") or pattern.get("type") != "ByteLevel" or pattern.get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path}: added tokens that take their surroundings")
    return tuple(sorted((a["content"] for a in added), key=len, reverse=True))


def literal(key: str) -> str:
    """The text that a key stands for."""
    return key[:-1] if key.endswith(" ") else " " + key


class Pieces:
    """A tokenizer, loaded where it encodes."""

    def __init__(self, path: str):
        # A task has one core: threads of the library would only hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.specials = special_tokens(path)
        self.tokenizer = Tokenizer.from_file(path)

    def counts(self, wanted: list[str]) -> list[int]:
        """Number of ids of each key."""
        found: list[int] = []
        for i in range(0, len(wanted), 2000):
            texts = [literal(k) for k in wanted[i : i + 2000]]
            found += [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]


# Characters that all Unicode versions of the last decade class alike.
_SETTLED = re.compile("[^\\x00-\\u052f\\u2000-\\u206f]")
_LONGEST = 1000


class RankedPieces(Pieces):
    """The same ids from the vocabulary as ranks, at twice the speed, where they are surely the same.

    That is for texts of settled characters without special tokens and without very long
    words or gaps, which the faster library handles badly. All others take the usual way.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        super().__init__(path)
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self._is_plain(t)]
        out = dict.fromkeys(range(len(texts)), b"")
        for i in plain:
            out[i] = self.ranked.encode_to_numpy(texts[i], disallowed_special=()).astype("<u4").tobytes()
        others = sorted(out.keys() - set(plain))
        out.update(zip(others, super().ids([texts[i] for i in others]), strict=True))
        return list(out.values())

    def _is_plain(self, text: str) -> bool:
        if not text.isascii() and _SETTLED.search(text):
            return False
        if any(s in text for s in self.specials) or " " * _LONGEST in text:
            return False
        return max(map(len, text.split(" "))) <= _LONGEST
