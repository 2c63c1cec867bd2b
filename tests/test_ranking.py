"""Ranks by ranges are those of the windows, and made by more than one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators.ranking import _ranked_by_ranges, rank_hits

HIT = "question_id string, id bigint, score double, k bigint"


def result(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def hits(spark):
    rng = np.random.default_rng(1)
    found = []
    for question, n, k in (("a", 5000, 3000), ("b", 40, 10**6), ("c", 3000, 1), ("d", 1, 1), ("e", 900, 450)):
        # Few scores: ties decide, also at the k-th place and where ranges end; "e" has one score only.
        scores = np.zeros(n) if question == "e" else np.round(rng.uniform(-1, 1, n), 2)
        found += [(question, int(i), float(s), k) for i, s in zip(rng.permutation(n), scores)]
    return spark.createDataFrame(found, HIT).repartition(7).cache()


def test_as_by_windows(hits):
    by_ranges = result(rank_hits(hits, 10**6, window_k=10))
    assert by_ranges == result(rank_hits(hits, 10**6, window_k=10**6))
    assert len(by_ranges) == 3000 + 40 + 1 + 1 + 450


def test_a_question_is_ranked_by_several_tasks(spark, hits):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few rows into one task
    try:
        ranked = _ranked_by_ranges(hits).where("question_id = 'a'")
        parts = ranked.groupBy("part").agg(F.count("*").alias("n")).collect()
        assert result(rank_hits(hits, 10**6, 10)) == result(rank_hits(hits, 10**6, 10**6))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(parts) > 1
    # Rows well below the 3,000th are not sorted at all.
    assert sum(r.n for r in parts) < 3200


def test_few_hits_are_shuffled_once(hits):
    few = hits.where("question_id in ('b', 'd')")
    assert result(rank_hits(few, 1000, scans=40)) == result(rank_hits(few, 1000))
    plans = [rank_hits(hits, 1000, scans=n)._jdf.queryExecution().executedPlan().toString() for n in (40, 200)]
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [1, 2]


def test_nothing(spark):
    assert rank_hits(spark.createDataFrame([], HIT), 10**6, window_k=10).collect() == []
