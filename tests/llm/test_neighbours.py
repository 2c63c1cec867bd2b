"""The permutation index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pagelore.llm.permutation_index import build_index, search


def brute(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for n, (q, v) in enumerate(use):
        if q % 50 == 0:
            scored = [
                (-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i)
                for m, (i, w) in enumerate(use)
                if m != n
            ]
            out.setdefault(q, []).append([(i, -s) for s, i in sorted(scored)[:k]])
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in search(build_index(frame), F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))]


def test_recall_and_scores(spark):
    rows = vectors(4000)
    want = {q: v[0] for q, v in brute(rows, 5).items()}
    for options in ({}, {"pass_bytes": 10_000}):
        got = found(spark, rows, **options)
        assert got.keys() == want.keys()
        hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
        assert hits >= 0.95 * 5 * len(want)
        exact = {q: dict(v) for q, v in want.items()}
        assert all(abs(exact[q][i] - s) < 1e-12 for q in got for i, s in got[q] if i in exact[q])
        assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_ties_and_odd_vectors(spark):
    rows = vectors(60)
    rows += [(100 + i, rows[0][1]) for i in range(1500)]  # very many copies of a query
    rows += [(50, None), (2000, [0.0] * 16), (2001, [float("nan")] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [1.0])]
    got = found(spark, rows)
    assert [i for i, _ in got[0]] == [100, 101, 102, 103, 104]
    assert [i for i, _ in got[100]] == [0, 101, 102, 103, 104]
    assert 2000 not in got
    assert all(len(v) == 5 for v in got.values())


def test_few_rows(spark):
    rows = vectors(3)
    got = found(spark, rows)
    assert {i for i, _ in got[0]} == {1, 2}
    assert found(spark, rows[:1]) == {}
    assert found(spark, []) == {}


def test_many_rows_of_few_vectors(spark):
    """Pivots come from distinct vectors, however often rows repeat."""
    four = [v for _, v in vectors(4)]
    rows = [(i, four[i % 4]) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = build_index(frame)
    assert index.pivots == 4
    got = {}
    for r in search(index, F.col("vec_id") % 5000 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [4, 8, 12, 16, 20], **{q: [0, 4, 8, 12, 16] for q in (5000, 10_000, 15_000)}}
