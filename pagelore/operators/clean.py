"""Page cleaning: empty pages out, markup out, empty pages out again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.rows import computed_once
from pagelore.functions.text import clean_content, clean_title


def drop_empty(pages: DataFrame) -> DataFrame:
    """Keep pages whose title and content are both present and non-empty."""
    return pages.where((F.col("title") != "") & (F.col("content") != ""))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Clean ``title`` and ``content``; all other columns pass through.

    Row by row: no shuffle, and any split of the input works alone.
    """
    others = [c for c in pages.columns if c not in ("title", "content")]
    cleaned = computed_once(
        clean_title(F.col("title")).alias("title"), clean_content(F.col("content")).alias("content")
    )
    return drop_empty(drop_empty(pages).select(*others, cleaned))
