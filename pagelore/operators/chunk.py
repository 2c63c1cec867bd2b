"""Splitting pages into token-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.tokens import SpaceTokenizer

# Fixed value: the default size limit of a chunk, in tokens.
MAX_TOKENS = 8192


def chunk_title(title: Column, chunk_no: Column, n_chunks: Column) -> Column:
    """Page title, with `` (i)`` counted from 1 when the page has several chunks."""
    numbered = F.concat(title, F.lit(" ("), (chunk_no + 1).cast("string"), F.lit(")"))
    return F.when(n_chunks > 1, numbered).otherwise(title)


def chunk_pages(
    pages: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: SpaceTokenizer | None = None
) -> DataFrame:
    """Cut each page into the longest prefixes of at most ``max_tokens`` tokens.

    In: ``page_id, title, content``. Out: ``page_id, chunk_no, n_chunks, title,
    content, tokens``. Chunks of a page join back to its content in order.
    """
    tokenizer = tokenizer or SpaceTokenizer()
    # The outer form, because for the inner one the optimizer derives a filter
    # on the array and then splits every text again to evaluate it.
    pieces = pages.select(
        "page_id", "title", tokenizer.split(F.col("content"), max_tokens).alias("pieces")
    ).select(
        "page_id",
        "title",
        F.size("pieces").alias("n_chunks"),
        F.posexplode_outer("pieces").alias("chunk_no", "content"),
    )
    return pieces.where(F.col("content").isNotNull()).select(
        "page_id",
        "chunk_no",
        "n_chunks",
        chunk_title(F.col("title"), F.col("chunk_no"), F.col("n_chunks")).alias("title"),
        "content",
        tokenizer.count(F.col("content")).alias("tokens"),
    )


def duplicate_keys(rows: DataFrame, key: str = "title") -> DataFrame:
    """Keys that occur more than once, with their counts.

    Counts are combined before the shuffle, so a key that fills a third of the
    table costs one row per input task.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where("n_rows > 1")


def require_unique_keys(rows: DataFrame, key: str = "title") -> None:
    """Raise if a key occurs twice; runs one counting job."""
    found = duplicate_keys(rows, key).limit(1).collect()
    if found:
        raise ValueError(f"duplicate {key}: {found[0][0]!r} occurs {found[0][1]} times")
