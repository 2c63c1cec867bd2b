"""Nearest neighbours by a permutation index (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import distinct_by_hash, map_arrow, stored


@dataclass(frozen=True)
class Index:
    """Every usable row with its permutation: the numbers of its ``prefix`` nearest pivots, nearest first."""

    rows: DataFrame
    pivots: int
    prefix: int
    dim: int


def build_index(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dim: int | None = None,
    pivots: int = 128,
    prefix: int = 64,
) -> Index:
    """The permutation of every vector, nearness being the cosine.

    Pivots are the ``pivots`` distinct vectors of smallest hash, a bounded sample; of fewer
    distinct ones, all. Rows whose
    vector is null, zero, holds null or non-finite components, or has not ``dim``
    components (by default the most frequent number) are not in the index.
    """
    values = F.col("vector")
    given = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(
        F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    if dim is None:
        sizes = given.groupBy(F.size(values).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = sizes["dim"] if sizes else 1
    given = given.where(F.size(values) == dim)
    sample = distinct_by_hash(given, "vector", pivots).orderBy("hash", "vector").toArrow()
    chosen = _matrix(sample["vector"].combine_chunks(), dim)
    chosen = chosen / np.linalg.norm(chosen, axis=1)[:, None]
    prefix = min(prefix, len(chosen))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column(2), dim) @ chosen.T
            nearest = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in nearest], pa.binary())],
                names=["row", "vec_id", "vector", "order"],
            )

    rows = map_arrow(given, order, "row long, vec_id long, vector array<double>, order binary")
    return Index(stored(rows, "permutations"), len(chosen), prefix, dim)


def search(
    index: Index,
    is_query: Column,
    k: int = 5,
    share: float = 0.2,
    at_least: int = 256,
    pass_bytes: int = 64 << 20,
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` nearest found to each row that ``is_query`` picks.

    Each task turns a batch of the index into inverted files, one for each pivot. A query
    adds up, over the files of its own nearest pivots, what ranks have in common: the
    footrule distance of the permutations is a constant less twice that. The batch's
    ``share`` of smallest distance (``at_least`` rows; all that are as near as the last)
    is ranked anew by exact cosine, in double precision. A task passes on ``k`` rows for
    each query. The queries are taken in passes of about ``pass_bytes``, which a task holds;
    in each pass the index stays where it lies.

    Equal scores go to the smaller ``vec_id``; equal vectors have equal scores. A row is
    no neighbour of itself, but of a row with the same id. A query with fewer than ``k``
    others gets all. No rows, or no queries, give no rows.
    """
    spark = index.rows.sparkSession
    queries = index.rows.where(is_query)
    passes = -(-queries.count() * (16 * index.dim + 2 * index.prefix) // pass_bytes)
    found = spark.createDataFrame([], "query long, vec_id long, score double, rank int")
    for number in range(passes):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == number).toArrow()
        asked = spark.sparkContext.broadcast(
            {
                "row": own["row"].to_numpy(),
                "vector": _matrix(own["vector"].combine_chunks(), index.dim),
                "order": _orders(own["order"].combine_chunks(), index.prefix),
            }
        )
        near = map_arrow(
            index.rows,
            _searcher(asked, index.pivots, index.prefix, index.dim, k, share, at_least),
            "query long, vec_id long, score double",
        )
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        ranked = near.withColumn("rank", best).where(F.col("rank") <= k)
        found = found.union(ranked)
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def _searcher(asked, pivots: int, prefix: int, dim: int, k: int, share: float, at_least: int):
    def search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors, orders = asked.value["row"], asked.value["vector"], asked.value["order"]
        n = len(rows)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        score = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        files = _Files(pivots, prefix)
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                part = batch.slice(low, 8192)
                own, vec_ids = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                there = _matrix(part.column(2), dim)
                their_lengths = np.sqrt((there * there).sum(axis=1))
                files.fill(_orders(part.column(3), prefix))
                want = min(len(own), max(at_least, int(np.ceil(share * len(own)))))
                for q in range(n):
                    common = files.common(orders[q])
                    cut = np.partition(common, len(common) - want)[len(common) - want]
                    at = np.flatnonzero((common >= cut) & (own != rows[q]))
                    cosine = (there[at] * vectors[q]).sum(axis=1) / (their_lengths[at] * lengths[q])
                    if len(at) > k:
                        least = max(score[q, -1], np.partition(cosine, len(at) - k)[len(at) - k])
                        near = np.flatnonzero(cosine >= least)
                        at, cosine = at[near], cosine[near]
                    both = np.concatenate([score[q], cosine])
                    names = np.concatenate([ids[q], vec_ids[at]])
                    best = np.lexsort((names, -both))[:k]
                    score[q], ids[q] = both[best], names[best]
        at, _ = np.nonzero(np.isfinite(score))
        if len(at):
            use = np.isfinite(score)
            yield pa.record_batch({"query": rows[at], "vec_id": ids[use], "score": score[use]})

    return search_batches


class _Files:
    """Inverted files of a batch: of each pivot the members it is near to, and how near."""

    def __init__(self, pivots: int, prefix: int):
        self.pivots, self.prefix = pivots, prefix

    def fill(self, orders: np.ndarray) -> None:
        self.n = len(orders)
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.member = by_pivot // self.prefix
        self.weight = (self.prefix - by_pivot % self.prefix).astype(np.float64)
        self.start = np.searchsorted(orders.ravel()[by_pivot], np.arange(self.pivots + 1))

    def common(self, order: np.ndarray) -> np.ndarray:
        """For each member, what its ranks have in common with those of ``order``."""
        spans = [slice(self.start[p], self.start[p + 1]) for p in order]
        member = np.concatenate([self.member[s] for s in spans])
        weight = np.concatenate([np.minimum(self.weight[s], self.prefix - i) for i, s in enumerate(spans)])
        return np.bincount(member, weights=weight, minlength=self.n)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _orders(column: pa.Array, prefix: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, prefix)
