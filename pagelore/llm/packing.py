"""Packing documents into token windows by Karmarkar-Karp differencing (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import map_arrow, text_slices
from pagelore.llm.differencing import windows
from pagelore.llm.pretokens import Pieces, RankedPieces

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    max_piece: int = 512,
    group: int = 4096,
    end_id: int = 0,
    ranks_path: str | None = None,
    ranks_pattern: str = "",
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of ``capacity`` tokens.

    A document is the ids of its text and ``end_id``. It is cut by itself alone: as many
    whole sequences as it fills, each a piece with a sequence to itself, then pieces of
    at most ``max_piece`` ids. ``group`` such pieces at a time are dealt out to nearly
    equal windows by differencing; a window is a sequence. All of this happens in the
    task that reads the document: nothing is shuffled, ids never leave it, and a
    sequence number holds the task's number, so tasks need not know of each other.
    Only the last group of a task is smaller, which costs part of one sequence.

    ``ranks_path`` and ``ranks_pattern`` may give the same vocabulary as ranks, which is
    faster and changes no id.

    A null text is an empty one (one piece with ``end_id``); a null ``doc_id`` stays
    null; a repeated row is packed again; other columns are left out, whatever their
    names. No rows give no pieces.
    """
    given: list[Column] = [
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.spark_partition_id().cast("long").alias("task"),
    ]

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path is None:
            pieces = Pieces(tokenizer_path)
        else:
            pieces = RankedPieces(tokenizer_path, ranks_path, ranks_pattern)
        end = int(end_id).to_bytes(4, "little")
        held: list[np.ndarray] = []
        n_held = used = 0
        for batch in batches:
            ids, texts, task = batch.column(0), batch.column(1), None
            for low, high in text_slices(texts):
                task = batch.column(2)[low].as_py()
                encoded = pieces.ids(texts.slice(low, high - low).to_pylist())
                whole, part = _cut(ids.slice(low, high - low), encoded, end, capacity, max_piece)
                if len(whole):
                    yield _placed(whole, task, used, np.arange(len(whole)))
                    used += len(whole)
                held.append(part)
                n_held += len(part)
                while n_held >= group:
                    rows = np.concatenate(held)
                    now, held = rows[:group], [rows[group:]]
                    n_held -= group
                    label = windows(now["length"], capacity)
                    yield _placed(now, task, used, label)
                    used += int(label.max()) + 1
        if n_held:
            rows = np.concatenate(held)
            yield _placed(rows, task, used, windows(rows["length"], capacity))

    return map_arrow(documents.select(given), pack_batches, SCHEMA)


_PIECE = np.dtype(
    [("doc_id", "i8"), ("null", "?"), ("start", "i8"), ("length", "i8"), ("crc", "i8"), ("tokens", "i8")]
)


def _cut(
    ids: pa.Array, encoded: list[bytes], end: bytes, capacity: int, max_piece: int
) -> tuple[np.ndarray, np.ndarray]:
    """The pieces that fill a sequence, and the others."""
    whole, part = [], []
    for doc, body in zip(ids.to_pylist(), encoded, strict=True):
        body += end
        n = len(body) // 4
        start = 0
        while start < n:
            length = capacity if n - start >= capacity else min(max_piece, n - start)
            crc = zlib.crc32(body[4 * start : 4 * (start + length)])
            row = (doc or 0, doc is None, start, length, crc, n)
            (whole if length == capacity else part).append(row)
            start += length
    return np.array(whole, _PIECE), np.array(part, _PIECE)


def _placed(rows: np.ndarray, task: int, used: int, label: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(label, kind="stable")
    rows, label = rows[order], label[order]
    before = np.cumsum(rows["length"]) - rows["length"]
    first = np.r_[True, label[1:] != label[:-1]]
    offset = before - before[first][np.cumsum(first) - 1]
    return pa.record_batch(
        {
            "doc_id": pa.array(rows["doc_id"], mask=rows["null"]),
            "start": rows["start"],
            "length": rows["length"],
            "ids_crc32": rows["crc"],
            "doc_tokens": rows["tokens"],
            "sequence_id": (task << 33) + used + label,
            "offset": offset,
        }
    )
