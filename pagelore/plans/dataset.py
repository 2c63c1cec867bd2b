"""From pages to a points table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.tokens import SpaceTokenizer
from pagelore.operators.chunk import MAX_TOKENS, chunk_pages, require_unique_keys
from pagelore.operators.clean import clean_pages
from pagelore.operators.embed import Embedder, embed
from pagelore.sources.batch_files import attach_embeddings, batch_requests, write_requests
from pagelore.sources.points import rebuild


def with_page_id(pages: DataFrame) -> DataFrame:
    """Give pages that come without ``page_id`` the hash of title and content, the same however they are read.

    Pages that come twice share it; ``rebuild`` tells their points apart.
    """
    if "page_id" in pages.columns:
        return pages
    return pages.withColumn("page_id", F.xxhash64("title", "content"))


def make_chunks(
    pages: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: SpaceTokenizer | None = None
) -> DataFrame:
    """Cleaned chunks of raw pages (``title, content``, perhaps ``page_id``)."""
    return chunk_pages(clean_pages(with_page_id(pages)), max_tokens, tokenizer)


def with_ids(embedded: DataFrame) -> DataFrame:
    """Points for direct use, without a table: ``id`` is page and chunk number."""
    number = F.format_string("%s:%06d", F.col("page_id").cast("string"), F.col("chunk_no"))
    return embedded.withColumn("id", number)


def build_points(
    pages: DataFrame,
    path: str,
    embedder: Embedder,
    dim: int,
    max_tokens: int = MAX_TOKENS,
    tokenizer: SpaceTokenizer | None = None,
    parallelism: int | None = None,
    dry_run: bool = False,
) -> int | DataFrame:
    """Clean, chunk, embed and rebuild in one pass; returns the new version.

    No stage before the write shuffles, unless ``parallelism`` bounds the model calls; pass
    pages that come in a few files through ``spread`` first. A dry run returns the planned points
    and writes nothing.
    """
    embedded = embed(make_chunks(pages, max_tokens, tokenizer), embedder, dim, parallelism=parallelism)
    return embedded if dry_run else rebuild(embedded, path, dim)


def export_batch(chunks: DataFrame, path: str, model: str, key: str = "title") -> None:
    """First half of a batch embedding: check the keys, write the request lines.

    Both halves read ``chunks`` more than once: pass a stored table.
    """
    require_unique_keys(chunks, key)
    write_requests(batch_requests(chunks, model, key), path)


def import_batch(chunks: DataFrame, results: DataFrame, path: str, dim: int, key: str = "title") -> int:
    """Second half: every chunk must have exactly one result, else the job fails; then rebuild.

    Results are parsed once: what is double shows in the join itself.
    """
    return rebuild(attach_embeddings(chunks, results, key), path, dim)
