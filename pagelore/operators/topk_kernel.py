"""Arrow-batch helpers for exact top-k: score a block of points, keep the best.

These run inside Spark tasks on one batch at a time; Spark does the
partitioning, the shuffling and the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pagelore.functions.vectors import SCORE_DIGITS

# Points and questions scored at once, 4 bytes per pair: a tile stays in a core's cache.
_POINTS = 2_000
_QUESTIONS = 400
# Of a tile of which more than one pair in so many passes all pairs are scored again.
_DENSE = 8
# Values of pairs scored again at once.
_AGAIN = 1 << 22
_OUTPUT_ROWS = 50_000
# Hits a task holds at most, but for those of one batch, before it passes them on.
_ROOM = 4_000_000


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """List array to a float64 matrix without visiting single values in Python."""
    lengths = np.diff(np.asarray(vectors.offsets))
    if vectors.null_count or (lengths != dim).any():
        raise ValueError(f"every embedding must have {dim} values")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit_rows(vectors: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them could be (finite and non-zero)."""
    if norms is None:
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    usable = np.isfinite(norms) & (norms > 0)
    if not usable.all():
        vectors, norms = np.where(usable[:, None], vectors, 0.0), np.where(usable, norms, 1.0)
    return vectors / norms[:, None], usable


def rounded(scores: np.ndarray) -> np.ndarray:
    # Adding zero turns -0.0 into 0.0, which Spark would order apart.
    return np.round(scores, SCORE_DIGITS) + 0.0


class BestPoints:
    """The best ``k[i]`` points seen so far for each question ``i``."""

    def __init__(self, vectors: np.ndarray, k: np.ndarray, floor: np.ndarray | None = None) -> None:
        self._vectors, usable = unit_rows(vectors)
        self._short = self._vectors.astype(np.float32)
        # Rounding and single precision move a score by less than this: the sum of n products of numbers
        # that make unit vectors is out by n units of the last place at most, the numbers by one each.
        self._slack = 10.0**-SCORE_DIGITS + (vectors.shape[1] + 8) * 2.0**-23
        self._k = np.where(usable, k, 0)
        # A score below its question's floor cannot be among the best any more.
        self._floor = np.full(len(k), -np.inf) if floor is None else floor.copy()
        # Scores of a tile: written over and over, as new memory for each takes longer than a comparison.
        self._tile = np.empty(min(_QUESTIONS, len(k)) * _POINTS, np.float32)
        self._kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n_kept = 0
        self._room = min(_ROOM, 2 * int(np.minimum(self._k, 1 << 40).sum()) + 100_000)

    def add(
        self,
        ids: np.ndarray,
        vectors: np.ndarray,
        norms: np.ndarray | None = None,
        asking: np.ndarray | None = None,
    ) -> None:
        """Consider points given as plain vectors, with their norms where those are known.

        With ``asking`` only those question rows see them.
        """
        units, usable = unit_rows(vectors, norms)
        if not usable.all():
            ids, units = ids[usable], units[usable]
        self.add_units(ids, units, asking)

    def add_units(self, ids: np.ndarray, units: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Consider points already scaled to length one."""
        if not len(ids):
            return
        asking = np.flatnonzero(self._k) if asking is None else asking[self._k[asking] > 0]
        short = units.astype(np.float32)
        for start in range(0, len(asking), _QUESTIONS):
            part = asking[start : start + _QUESTIONS]
            vectors = self._short[part]
            for first in range(0, len(ids), _POINTS):
                tile = slice(first, first + _POINTS)
                self._add_tile(ids[tile], units[tile], part, vectors, short[tile])

    def _add_tile(
        self, ids: np.ndarray, units: np.ndarray, part: np.ndarray, vectors: np.ndarray, short: np.ndarray
    ) -> None:
        """``vectors`` and ``short`` are those of the questions and points in single precision."""
        near = self._tile[: len(part) * len(short)].reshape(len(part), len(short))
        np.matmul(vectors, short.T, out=near)
        self._raise_floor(near, part)
        least = (self._floor[part] - self._slack).astype(np.float32)
        # Once floors are high few questions have anything in a tile: cells are compared for those only,
        # in single precision; only what passes is scored in double, rounded and compared again.
        open_ = np.flatnonzero(near.max(axis=1) >= least)
        if not len(open_):
            return
        cells = near if len(open_) == len(part) else near[open_]
        rows, cols = np.divmod(np.flatnonzero(cells >= least[open_, None]), near.shape[1])
        rows = open_[rows]
        found = rounded(self._exact(units, part, rows, cols))
        passed = found >= self._floor[part][rows]
        self._keep(part[rows[passed]], found[passed], ids[cols[passed]])

    def _exact(self, units: np.ndarray, part: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores of some pairs of a tile, in double precision."""
        if len(rows) * _DENSE > len(part) * len(units):
            return (self._vectors[part] @ units.T)[rows, cols]
        scores = np.empty(len(rows))
        step = max(1, _AGAIN // units.shape[1])
        for low in range(0, len(rows), step):
            some = slice(low, low + step)
            scores[some] = np.einsum("ij,ij->i", self._vectors[part[rows[some]]], units[cols[some]])
        return scores

    def _raise_floor(self, near: np.ndarray, part: np.ndarray) -> None:
        """Give questions without a floor their k-th best score of this block, or a little less."""
        n = near.shape[1]
        wanted = self._k[part]
        unbounded = np.isneginf(self._floor[part]) & (wanted < n)
        if not unbounded.any():
            return
        for k in np.unique(wanted[unbounded]):
            rows = np.flatnonzero(unbounded & (wanted == k))
            kth = np.partition(near[rows], n - k, axis=1)[:, n - k]
            self._floor[part[rows]] = kth.astype(np.float64) - self._slack

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self._kept.append((rows, scores, ids))
        self._n_kept += len(rows)
        if self._n_kept > self._room:
            self._prune()

    def _prune(self) -> None:
        rows, scores, ids = (np.concatenate(column) for column in zip(*self._kept))
        order = np.lexsort((-scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        inside = place < self._k[rows]
        last = place == self._k[rows] - 1
        self._floor[rows[last]] = scores[last]
        # Ids, slow to compare, decide only where the k-th score goes on behind the k-th place.
        torn = np.unique(rows[~inside & (scores == self._floor[rows])])
        if len(torn):
            tied = np.flatnonzero(np.isin(rows, torn) & (scores == self._floor[rows]))
            _, id_rank = np.unique(ids[tied], return_inverse=True)
            ids[tied] = ids[tied[np.lexsort((id_rank, rows[tied]))]]
        self._kept = [(rows[inside], scores[inside], ids[inside])]
        self._n_kept = int(inside.sum())

    def is_full(self) -> bool:
        """Whether what is kept fills the room although it is pruned."""
        if self._n_kept <= self._room:
            return False
        self._prune()
        return 2 * self._n_kept > self._room

    def forget(self) -> None:
        """Drop what is kept, which was passed on; floors stay, so what follows is better."""
        self._kept, self._n_kept = [], 0

    def wanted(self, rows: np.ndarray) -> np.ndarray:
        """``k`` of each of the given question rows."""
        return self._k[rows]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question row, score and point id of everything kept."""
        if not self._kept:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self._prune()
        return self._kept[0]


def score_partition(
    batches: Iterable[pa.RecordBatch], questions: pa.Table, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Stream a partition of ``id, embedding``, perhaps ``norm``, past a bounded table of questions.

    Questions may have a ``floor`` below which nothing is wanted.
    """
    vectors = questions["embedding"].combine_chunks()
    dim = len(vectors[0])
    floor = questions["floor"].to_numpy() if "floor" in questions.column_names else None
    best = BestPoints(matrix(vectors, dim), questions["k"].to_numpy(), floor)
    for batch in batches:
        norms = batch["norm"].to_numpy(zero_copy_only=False) if "norm" in batch.schema.names else None
        best.add(batch["id"].to_numpy(zero_copy_only=False), matrix(batch["embedding"], dim), norms)
        if best.is_full():
            yield from _hits(best, questions["question_id"].combine_chunks(), schema)
            best.forget()
    yield from _hits(best, questions["question_id"].combine_chunks(), schema)


def score_clusters(
    batches: Iterable[pa.RecordBatch], questions: pa.Table, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Like :func:`score_partition`, but a question sees the points of the ``clusters`` it names only.

    Points have a ``cluster`` too, and questions a ``floor`` below which nothing is wanted.
    """
    vectors = questions["embedding"].combine_chunks()
    best = BestPoints(
        matrix(vectors, len(vectors[0])), questions["k"].to_numpy(), questions["floor"].to_numpy()
    )
    named = questions["clusters"].combine_chunks()
    rows = np.repeat(np.arange(len(named)), np.diff(np.asarray(named.offsets)))
    clusters = named.flatten().to_numpy()
    order = np.argsort(clusters, kind="stable")
    rows, clusters = rows[order], clusters[order]
    ids = questions["question_id"].combine_chunks()
    for batch in batches:
        found = batch["cluster"].to_numpy()
        point_ids, units = batch["id"].to_numpy(zero_copy_only=False), matrix(batch["embedding"], len(vectors[0]))
        for cluster in np.unique(found):
            first, last = np.searchsorted(clusters, [cluster, cluster + 1])
            if first < last:
                here = found == cluster
                best.add(point_ids[here], units[here], asking=rows[first:last])
        if best.is_full():
            yield from _hits(best, ids, schema)
            best.forget()
    yield from _hits(best, ids, schema)


def _hits(best: BestPoints, question_ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, scores, ids = best.result()
    for start in range(0, len(rows), _OUTPUT_ROWS):
        part = slice(start, start + _OUTPUT_ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                question_ids.take(pa.array(rows[part], pa.int64())).cast(schema.field("question_id").type),
                pa.array(ids[part], schema.field("id").type),
                pa.array(scores[part], pa.float64()),
                pa.array(best.wanted(rows[part]), pa.int64()),
            ],
            schema=schema,
        )
