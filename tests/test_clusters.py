"""Vectors laid out by direction: equal rows, fewer folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators.clustered import further_folders, near_folders, top_k_clustered
from pagelore.operators.retrieve import asked_once, top_k_batch
from pagelore.sources.clusters import read_blocks, read_vectors, write_clusters
from tests.test_retrieve import make_points, make_questions, rows


def both(spark, tmp_path, points, questions, clusters, **options):
    path = str(tmp_path / "clusters")
    write_clusters(points, path, clusters)
    return rows(top_k_clustered(spark, path, questions, **options)), rows(top_k_batch(points, questions))


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 300}])
def test_ties_and_repeated_vectors(spark, tmp_path, options):
    rng = np.random.default_rng(3)
    points = make_points(spark, rng.integers(-1, 2, (300, 4)))
    ks = [int(k) for k in rng.integers(0, 12, 38)] + [None, 1000, 3, 3]
    questions = make_questions(spark, [*rng.integers(-1, 2, (40, 4)).tolist(), [0, 0, 0, 0], None], ks)
    got, want = both(spark, tmp_path, points, questions, 7, **options)
    assert got == want and len(want) > 400


def test_most_copies_of_one_vector(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = np.vstack([np.tile([1.0, 2.0, 3.0], (900, 1)), rng.normal(size=(100, 3))])
    questions = make_questions(spark, [[1, 2, 3], [-1, 0, 0.5]], [950, 20])
    got, want = both(spark, tmp_path, make_points(spark, vectors), questions, 16)
    assert got == want and len(want) == 970


def test_vectors_that_cannot_be_ranked(spark, tmp_path):
    points = make_points(spark, [[1, 0], [0, 0], [float("nan"), 1], [float("inf"), 1]])
    points = points.union(spark.createDataFrame([("null", "t", "c", None)], points.schema))
    got, want = both(spark, tmp_path, points, make_questions(spark, [[1, 1]], [9]), 4)
    assert got == want and [r[3] for r in got] == ["p0000"]


def test_no_points_and_no_questions(spark, tmp_path):
    points, questions = make_points(spark, [[1, 0]]), make_questions(spark, [[1, 1]], [3])
    assert both(spark, tmp_path / "a", points.limit(0), questions, 4) == (set(), set())
    assert both(spark, tmp_path / "b", points, questions.limit(0), 4) == (set(), set())


def test_most_vectors_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 24))
    vectors = np.repeat(centres, 60, axis=0) + rng.normal(scale=0.05, size=(3000, 24))
    points = make_points(spark, vectors)
    near = centres[rng.integers(0, 50, 20)] + rng.normal(scale=0.05, size=(20, 24))
    questions = make_questions(spark, near.tolist(), [5] * 20)
    got, want = both(spark, tmp_path, points, questions, 100)
    assert got == want

    path = str(tmp_path / "clusters")
    blocks = read_blocks(spark, path)
    sizes = {r.cluster: r.n for r in blocks.collect()}
    assert sum(sizes.values()) == 3000
    first = near_folders(asked_once(questions), blocks).checkpoint()
    hits = top_k_clustered(spark, path, questions)
    more = further_folders(first, hits, blocks)
    read = sum(sizes[c] for step in (first, more) for r in step.collect() for c in r.clusters)
    # 20 questions against 3,000 vectors are 60,000 pairs.
    assert read < 6000


def test_folders_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(6)
    path = str(tmp_path / "clusters")
    write_clusters(make_points(spark, rng.normal(size=(400, 3))), path, 8)
    some = read_vectors(spark, path).where(F.col("cluster").isin([1, 2]))
    assert len(some.inputFiles()) >= 8
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cluster" in plan.split("PartitionFilters")[1]
