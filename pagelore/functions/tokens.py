"""Token counting and token-bounded splitting behind one small interface.

A tokenizer has ``count(column)`` and ``split(column, max_tokens)``. The default
one runs on built-in functions only; :class:`CallableTokenizer` puts a caller's
own model tokenizer (a BPE, say) behind the same two methods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagelore.session import bound_batches


class SpaceTokenizer:
    """A token is a run of non-spaces with the one space before it, or a lone space.

    The tokens tile any text without loss, so chunks always join back to it.
    """

    def count(self, text: Column) -> Column:
        # Every token but a leading word starts with a space, and every space
        # starts a token: counting spaces is enough, no token array is built.
        spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
        leading_word = F.when((text != "") & ~F.startswith(text, F.lit(" ")), 1).otherwise(0)
        return (spaces + leading_word).cast("int")

    def split(self, text: Column, max_tokens: int) -> Column:
        # Possessive quantifiers: the regex engine walks the text once, iterates
        # instead of recursing, and yields whole chunks rather than tokens.
        pattern = r"(?: ?[^ ]++| ){1,%d}+" % _positive(max_tokens)
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


class CallableTokenizer:
    """Adapter for a caller's tokenizer.

    ``token_ends`` gets a batch of texts and returns, for each, the offsets (in
    characters, ascending) at which its tokens end; what follows the last one is a
    token too. It must be picklable and runs in Arrow batches on the executors, once for
    each text. A text is cut behind every ``max_tokens``-th token.
    """

    def __init__(self, token_ends: Callable[[pd.Series], Iterable[Sequence[int]]]) -> None:
        self._token_ends = token_ends

    def count(self, text: Column) -> Column:
        ends = self._checked_ends

        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            return pd.Series([None if e is None else len(e) for e in ends(texts)], dtype="Int32")

        bound_batches(SparkSession.active())
        return counted.asNondeterministic()(text)

    def split(self, text: Column, max_tokens: int) -> Column:
        _positive(max_tokens)
        ends = self._checked_ends

        def pieces(whole: str, tokens: list[int]) -> list[str]:
            cuts = [0, *tokens[max_tokens - 1 : -1 : max_tokens], len(whole)]
            return [whole[i:j] for i, j in zip(cuts, cuts[1:]) if j > i]

        @F.pandas_udf("array<string>")
        def split_texts(texts: pd.Series) -> pd.Series:
            found = zip(texts, ends(texts), strict=True)
            return pd.Series([None if e is None else pieces(t, e) for t, e in found], dtype=object)

        bound_batches(SparkSession.active())
        return split_texts.asNondeterministic()(text)

    def _checked_ends(self, texts: pd.Series) -> list[list[int] | None]:
        """Ends of each text's tokens, the last one included; nothing for null."""
        known = texts[texts.notna()]
        given = [list(e) for e in self._token_ends(known)] if len(known) else []
        if len(given) != len(known):
            raise ValueError(f"{len(known)} texts gave {len(given)} lists of tokens")
        for whole, ends in zip(known, given, strict=True):
            if any(j <= i for i, j in zip([0, *ends], ends)) or (ends and ends[-1] > len(whole)):
                raise ValueError("token ends must ascend within the text")
            if len(whole) > (ends[-1] if ends else 0):
                ends.append(len(whole))
        filled = iter(given)
        return [next(filled) if there else None for there in texts.notna()]


def _positive(max_tokens: int) -> int:
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    return max_tokens
