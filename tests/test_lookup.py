import pytest
from pyspark.sql import functions as F

from pagelore.operators.lookup import _only_wanted, lookup


@pytest.mark.parametrize("limit", [0, 10**6])
def test_equals_an_inner_join(spark, limit):
    table = spark.range(5000).select(F.col("id").cast("string").alias("key"), (F.col("id") * 3).alias("value"))
    # One key wanted by a third of the rows, some wanted twice, some that do not exist.
    wanted = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") * 2).cast("string")).alias("key"),
        F.col("id").alias("row"),
    )
    got = lookup(table, wanted, "key", max_broadcast_rows=limit)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.join(wanted, "key").collect()))


def test_bitmap_keeps_the_wanted_and_little_else(spark):
    table = spark.range(50_000).withColumnRenamed("id", "key")
    wanted = spark.range(0, 50_000, 50).withColumnRenamed("id", "key")
    kept = {r.key for r in _only_wanted(table, wanted, "key").collect()}
    assert {r.key for r in wanted.collect()} <= kept
    assert len(kept) < 1010


def test_bitmap_filter_needs_no_shuffle_of_the_table(spark):
    table = spark.range(1000).withColumnRenamed("id", "key")
    plan = _only_wanted(table, table.limit(10), "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_key_types_may_differ(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "key int, value string")
    wanted = spark.createDataFrame([(2, "x"), (2**40, "y")], "key bigint, other string")
    for limit in (0, 10):
        assert [tuple(r) for r in lookup(table, wanted, "key", None, limit).collect()] == [(2, "b", "x")]
