"""Main text of web pages (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import arrow_column, text_slices
from pagelore.llm.html_blocks import main_text


def extracted(html: Column) -> Column:
    """Main text of a page, in Arrow batches; a null page has none."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            texts: list[str] = []
            for low, high in text_slices(pages):
                texts += [main_text(page or "") for page in pages.slice(low, high - low).to_pylist()]
            yield pa.array(texts, pa.string())

    return arrow_column(extract, "string", html)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``page_id, url, text, n_chars``, one per row of ``pages``.

    A page that is null, empty or without an article has the empty text; repeated rows
    get equal texts; null ids and urls stay null; other columns are left out, whatever
    their names. No rows give no rows.
    """
    return pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), extracted(F.col(html)).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
