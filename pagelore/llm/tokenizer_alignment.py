"""Two tokenizers' tokens of the same texts, aligned byte by byte (operator 13)."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import map_arrow, stored, text_slices
from pagelore.llm.pretokens import RankedPieces

# Most pairs that every task gets a table of: 16 bytes each.
MAX_FREQUENT = 500_000

_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def align_tokenizers(
    documents: DataFrame,
    byte_path: str,
    piece_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    max_frequent: int = MAX_FREQUENT,
    ranks_path: str | None = None,
    ranks_pattern: str = "",
) -> DataFrame:
    """Rows ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one per document.

    A space and the text are encoded by a byte-level BPE tokenizer (A), the text by a
    piece tokenizer (B), which adds the space; special tokens' strings are plain text. Where
    tokens of both end, groups end; tokens whose bytes overlap are linked. A pair of ids
    counts as often as it is linked in all documents; ``count_sum`` adds up the counts of a
    document's links, ``n_best`` are the links whose count no other A id reaches for the B id.
    The hash is that of ``a1,a2|b1;a3|b2,b3``, the ids of each group.

    Documents are shuffled by their full text; each distinct text is encoded and aligned
    once, and its links weigh as much as it has documents. The most frequent pairs are a
    table in every task, the others are joined. Measures go back to documents by the text's
    SHA-256. ``ranks_path`` and ``ranks_pattern`` may give the vocabulary of A as ranks, which is
    faster where the ids are surely the same (see ``RankedPieces``).

    Zeros and an empty hash: texts null or empty, and texts that the tokens of either do not
    spell. Null ids stay null, repeated rows are documents of their own. Other columns are
    left out, whatever their names. No rows give no rows. A task holds all tokens of a text.
    """
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = F.coalesce(F.col("text") != "", F.lit(False))
    aligned = stored(aligned_texts(given.where(some), byte_path, piece_path, ranks_path, ranks_pattern), "aligned")
    measured = _measured(aligned, pair_counts(aligned), max_frequent)
    zero = F.lit(0).cast("long")
    names = (*_MEASURES, "n_best", "count_sum")
    without = given.where(~some).select("doc_id", *(zero.alias(c) for c in names), F.lit("").alias("groups_sha256"))
    with_text = given.where(some).select("doc_id", _digest(F.col("text")).alias("digest"))
    return with_text.join(measured, "digest").select("doc_id", *names, "groups_sha256").union(without)


def aligned_texts(
    documents: DataFrame, byte_path: str, piece_path: str, ranks_path: str | None = None, ranks_pattern: str = ""
) -> DataFrame:
    """Each distinct ``text`` once: its ``digest``, ``times`` it occurs, measures, and linked pairs.

    ``a``, ``b`` and ``links`` are its distinct pairs of linked ids and how often each is linked.
    """
    distinct = documents.groupBy("text").agg(F.count("*").alias("times"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers(byte_path, piece_path, ranks_path, ranks_pattern)
        for batch in batches:
            texts = batch.column("text")
            for low, high in text_slices(texts):
                found = both.align(texts.slice(low, high - low).to_pylist())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("times"), *found.columns],
                    ["digest", "times", *found.schema.names],
                )

    return map_arrow(
        distinct.select(_digest(F.col("text")).alias("digest"), "times", "text"),
        align,
        "digest binary, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "a array<int>, b array<int>, links array<int>",
    )


def pair_counts(aligned: DataFrame, max_kept: int = 1_000_000) -> DataFrame:
    """``a, b, n``: how many links of all documents hold each pair of ids."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs, links, row = _flat(batch)
            new = links * batch.column("times").to_numpy()[row]
            keys, inverse = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
            both = np.concatenate([counts, new])
            order = np.argsort(inverse, kind="stable")
            counts = np.add.reduceat(both[order], np.searchsorted(inverse[order], np.arange(len(keys)))) if len(keys) else both
            if len(keys) > max_kept:
                yield _counted(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield _counted(keys, counts)

    return (
        map_arrow(aligned.select("times", "a", "b", "links"), tally, "a int, b int, n long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"))
    )


def _measured(aligned: DataFrame, counts: DataFrame, max_frequent: int) -> DataFrame:
    """``digest``, the measures, ``n_best`` and ``count_sum`` of each distinct text."""
    spark = aligned.sparkSession
    counts = stored(counts, "pairs")
    # As many rows as the piece tokenizer has ids, at most.
    most = counts.groupBy("b").agg(F.max("n").alias("n")).toArrow()
    frequent = _frequent(counts, max_frequent).toArrow()
    keys = _keys(frequent["a"].to_numpy(), frequent["b"].to_numpy())
    order = np.argsort(keys)
    best = np.zeros(int(max(most["b"].to_numpy(), default=0)) + 1, np.int64)
    best[most["b"].to_numpy()] = most["n"].to_numpy()
    known = spark.sparkContext.broadcast((keys[order], frequent["n"].to_numpy()[order], best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            pairs, links, row = _flat(batch)
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n = np.where(found, counts[at] if len(keys) else 0, 0)
            is_best = found & (n == best[pairs & 0xFFFFFFFF])
            rare = np.flatnonzero(~found)
            heads, size = batch.num_rows, batch.num_rows + len(rare)
            tail = pa.nulls(len(rare), pa.int64())
            ids = batch.column("row").to_numpy()
            yield pa.record_batch(
                {
                    "row": np.concatenate([ids, ids[row[rare]]]),
                    "is_head": np.arange(size) < heads,
                    "digest": pa.concat_arrays([batch.column("digest"), pa.nulls(len(rare), pa.binary())]),
                    **{c: pa.concat_arrays([batch.column(c), tail]) for c in _MEASURES},
                    "groups_sha256": pa.concat_arrays([batch.column("groups_sha256"), pa.nulls(len(rare), pa.string())]),
                    "n_best": pa.concat_arrays([pa.array(_summed(links * is_best, row, heads)), tail]),
                    "count_sum": pa.concat_arrays([pa.array(_summed(links * n, row, heads)), tail]),
                    "a": pa.concat_arrays([pa.nulls(heads, pa.int32()), pa.array((pairs[rare] >> 32).astype(np.int32))]),
                    "b": pa.concat_arrays(
                        [pa.nulls(heads, pa.int32()), pa.array((pairs[rare] & 0xFFFFFFFF).astype(np.int32))]
                    ),
                    "links": pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(links[rare])]),
                }
            )

    kinds = (
        "row long, is_head boolean, digest binary, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, n_best long, count_sum long, a int, b int, links long"
    )
    read = map_arrow(aligned.withColumn("row", F.monotonically_increasing_id()), look_up, kinds)
    told = counts.join(F.broadcast(spark.createDataFrame(most).withColumnRenamed("n", "most")), "b").select(
        "a", "b", "n", (F.col("n") == F.col("most")).alias("best")
    )
    # A head has a key of its own: none is hot. No id is below zero.
    own = F.when(F.col("is_head"), -1 - F.col("row")).otherwise(F.col("a").cast("long"))
    rare = read.withColumn("key", own).withColumn("b", F.coalesce("b", F.lit(-1)))
    joined = rare.join(told.withColumnRenamed("n", "n_pair").withColumn("key", F.col("a").cast("long")).drop("a"), ["key", "b"], "left")
    more = F.coalesce(F.col("links") * F.col("n_pair"), F.lit(0))
    return (
        joined.groupBy("row")
        .agg(
            F.max("digest").alias("digest"),
            *(F.max(c).alias(c) for c in (*_MEASURES, "groups_sha256")),
            (F.max("n_best") + F.sum(F.when(F.col("best"), F.col("links")).otherwise(0))).alias("n_best"),
            (F.max("count_sum") + F.sum(more)).alias("count_sum"),
        )
        .drop("row")
    )


class TwoTokenizers:
    """Both tokenizers, loaded where they encode, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str, ranks_path: str | None = None, ranks_pattern: str = ""):
        # A task has one core: threads of the library would only hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.ranked = RankedPieces(byte_path, ranks_path, ranks_pattern) if ranks_path else None
        self.a = self.ranked.tokenizer if self.ranked else Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = _byte_level(byte_path, self.a.get_vocab_size())
        self.b_bytes = [_piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_lengths = np.array([len(t) for t in self.a_bytes])
        self.b_lengths = np.array([len(t) for t in self.b_bytes])
        # Ids as they are written: A ids before , and |, then B ids before , and ; and nothing.
        self.written = [b"%d%c" % (i, s) for i in range(len(self.a_bytes)) for s in b",|"]
        self.written += [b"%d%b" % (i, s) for i in range(len(self.b_bytes)) for s in (b",", b";", b"")]

    def align(self, texts: list[str]) -> pa.RecordBatch:
        spelled = [" " + t for t in texts]
        if self.ranked:
            a = [np.frombuffer(ids, "<u4").tolist() for ids in self.ranked.ids(spelled)]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(spelled, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for i, whole in enumerate(spelled):
            whole = whole.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a[i])) == whole
            if not same or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i] = b[i] = []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        # Where tokens end, in all texts written one after the other.
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        is_end = np.zeros(int(a_ends[-1]) + 1 if len(a) else 0, bool)
        is_end[a_ends] = is_end[b_ends] = True
        ends = np.flatnonzero(is_end)
        # Two tokens overlap in one run of bytes, and each run between ends is such.
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        row = np.repeat(np.arange(len(texts)), n_a)[of_a]
        closes = (a_ends[of_a] == ends) & (b_ends[of_b] == ends) if len(ends) else np.zeros(0, bool)
        pairs = _keys(a[of_a], b[of_b])
        order = np.lexsort((pairs, row))
        row_sorted, pairs = row[order], pairs[order]
        first = np.flatnonzero(np.r_[True, (np.diff(pairs) != 0) | (np.diff(row_sorted) != 0)]) if len(pairs) else order
        links = np.diff(np.r_[first, len(pairs)]).astype(np.int32)
        offsets = pa.array(np.searchsorted(row_sorted[first], np.arange(len(texts) + 1)).astype(np.int32))

        def lists(values):
            return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))

        return pa.record_batch(
            {
                "n_a": n_a,
                "n_b": n_b,
                "n_groups": np.bincount(row[closes], minlength=len(texts)),
                "n_links": np.bincount(row, minlength=len(texts)),
                "groups_sha256": pa.array(self._digests(a, b, a_ends, b_ends, ends[closes], n_a, n_b), pa.string()),
                "a": lists(pairs[first] >> 32),
                "b": lists(pairs[first] & 0xFFFFFFFF),
                "links": lists(links),
            }
        )

    def _digests(self, a, b, a_ends, b_ends, group_ends, n_a, n_b) -> list[str]:
        """Hash of the written groups of each text; empty for one without tokens."""
        in_a, in_b = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
        text_ends = np.cumsum(n_b)
        is_last = np.zeros(len(b), bool)
        is_last[text_ends[n_b > 0] - 1] = True
        a_closes = np.diff(in_a, append=-1) != 0
        b_closes = np.diff(in_b, append=-1) != 0
        codes = np.empty(len(a) + len(b), np.int64)
        # Of each group first the A ids, then the B ids.
        codes[np.arange(len(a)) + np.searchsorted(in_b, in_a)] = 2 * a + a_closes
        codes[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = (
            2 * len(self.a_bytes) + 3 * b + b_closes + is_last
        )
        found, start = [], 0
        for n in (n_a + n_b).tolist():
            written = b"".join(map(self.written.__getitem__, codes[start : start + n].tolist()))
            found.append(hashlib.sha256(written).hexdigest() if n else "")
            start += n
        return found


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _piece(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _byte_level(path: str, size: int) -> list[bytes]:
    """The bytes of each id of a byte-level BPE tokenizer.

    Its entries are written in characters that stand for bytes: printable ones of Latin-1 for
    themselves, the other bytes in order for the characters from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    found = [b""] * size
    for entry, i in about["model"]["vocab"].items():
        found[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return found


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their links and their row, of all rows of a batch."""
    sizes = np.diff(batch.column("a").offsets.to_numpy())
    a, b, links = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "links"))
    return _keys(a, b), links.astype(np.int64), np.repeat(np.arange(batch.num_rows), sizes)


def _summed(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of each row's values, exactly; rows are in order."""
    total = np.r_[0, np.cumsum(values)]
    return total[np.searchsorted(row, np.arange(n), "right")] - total[np.searchsorted(row, np.arange(n))]


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {"a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "n": counts.astype(np.int64)}
    )


def _frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """The pairs that are linked at least so often that not more than ``at_most`` are."""
    # Counts fall into 64 * 16 steps at most, so their histogram is small.
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for found in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += found["count"]
        if total > at_most:
            break
        least = found["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).select("a", "b", "n")
