"""Token counts from distinct pre-tokens (operator 10)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import map_arrow, stored, text_slices
from pagelore.llm.pretokens import Pieces, halves, keys, special_tokens

# Most pre-tokens that every task gets a table of: at most some 20 MB.
MAX_FREQUENT = 100_000


def token_counts(
    documents: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens, over_limit``, one per row of ``documents``.

    Each distinct pre-token is tokenized once. The most frequent ones (``max_frequent``
    at most, none longer than 64 characters) are a table in every task, so a pre-token
    of all documents is never a key of a shuffle; the others are joined by pre-token,
    with their number in the document, and summed. Ids are never kept.

    A null text has no bytes and no tokens; a null ``doc_id`` stays null; a repeated row
    is counted again; other columns are left out, whatever their names. No rows give no
    rows.
    """
    documents = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    vocabulary = stored(_vocabulary(documents, tokenizer_path), "pretokens")
    known = dict(_frequent(vocabulary, max_frequent).collect())
    broadcast = documents.sparkSession.sparkContext.broadcast(known)
    specials = special_tokens(tokenizer_path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = broadcast.value
        for batch in batches:
            for low, high in text_slices(batch.column("text")):
                part = batch.slice(low, high - low)
                n, rare_row, rare_key, rare_n = [], [], [], []
                rows = part.column("row").to_pylist()
                for row, whole in zip(rows, part.column("text").to_pylist(), strict=True):
                    total = 0
                    for key, times in Counter(keys(whole, specials)).items():
                        for half in halves(key):
                            count = frequent.get(half)
                            if count is None:
                                rare_row.append(row)
                                rare_key.append(half)
                                rare_n.append(times)
                            else:
                                total += times * count
                    n.append(total)
                heads = part.num_rows
                yield pa.record_batch(
                    {
                        "row": pa.array(rows + rare_row, pa.int64()),
                        "is_head": pa.array([True] * heads + [False] * len(rare_row)),
                        "doc_id": pa.concat_arrays([part.column("doc_id"), pa.nulls(len(rare_row), pa.int64())]),
                        "n_bytes": pa.concat_arrays([part.column("n_bytes"), pa.nulls(len(rare_row), pa.int64())]),
                        "pretoken": pa.array([None] * heads + rare_key, pa.string()),
                        "n": pa.array(n + rare_n, pa.int64()),
                    }
                )

    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "text",
    )
    read = map_arrow(
        numbered, look_up, "row long, is_head boolean, doc_id long, n_bytes long, pretoken string, n long"
    )
    # Rows without a pre-token to look up get a key of their own: none is hot. No key of
    # a vocabulary has two spaces at its end after a space.
    key = F.coalesce("pretoken", F.concat(F.lit(" "), F.col("row").cast("string"), F.lit("  ")))
    rare = vocabulary.select(F.col("pretoken").alias("key"), "pieces")
    return (
        read.withColumn("key", key)
        .join(rare, "key", "left")
        .groupBy("row")
        .agg(
            F.max(F.when(F.col("is_head"), F.col("doc_id"))).alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.when(F.col("is_head"), 1).otherwise(F.col("pieces"))).alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _vocabulary(documents: DataFrame, tokenizer_path: str, max_kept: int = 150_000) -> DataFrame:
    """Rows ``pretoken, n, pieces``: every distinct pre-token, how often it occurs, its tokens.

    A task adds up in tables of ``max_kept`` cuts of texts or so, then passes them on.
    """
    specials = special_tokens(tokenizer_path)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            texts = batch.column(0)
            for low, high in text_slices(texts):
                for whole in texts.slice(low, high - low).to_pylist():
                    counts.update(keys(whole, specials))
                if len(counts) > max_kept:
                    yield from _counted(counts)
                    counts.clear()
        yield from _counted(counts)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer_path)
        for batch in batches:
            found: list[int] = []
            for low, high in text_slices(batch.column("pretoken")):
                found += pieces.counts(batch.column("pretoken").slice(low, high - low).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64())], names=["pretoken", "n", "pieces"]
            )

    tallied = map_arrow(documents.select("text"), tally, "pretoken string, n long")
    summed = tallied.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return map_arrow(summed, tokenize, "pretoken string, n long, pieces long")


def _counted(counts: Counter[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    by_half: Counter[str] = Counter()
    for key, times in counts.items():
        for half in halves(key):
            by_half[half] += times
    names, numbers = list(by_half.keys()), list(by_half.values())
    for i in range(0, len(names), rows):
        yield pa.record_batch(
            {"pretoken": pa.array(names[i : i + rows], pa.string()), "n": pa.array(numbers[i : i + rows], pa.int64())}
        )


def _frequent(vocabulary: DataFrame, at_most: int) -> DataFrame:
    """``pretoken, pieces`` of all that occur at least so often that not more than ``at_most`` do."""
    short = vocabulary.where(F.length("pretoken") <= 64)
    # Frequencies fall into 64 * 16 steps at most, so their histogram is small.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for found in steps:
        total += found["count"]
        if total > at_most:
            break
        least = found["step"]
    return short.where(step >= least if least is not None else F.lit(False)).select("pretoken", "pieces")
