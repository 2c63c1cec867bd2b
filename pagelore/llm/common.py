"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute known)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.session import bound_batches, scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage like a checkpoint, and gives the optimizer the true size, so that
    Spark itself decides whether a side is small enough to broadcast.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def free_prefix(rows: DataFrame, prefix: str) -> str:
    """``prefix`` with as many underscores as it takes for no column to begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in rows.columns):
        prefix += "_"
    return prefix


def every_column(rows: DataFrame) -> list[Column]:
    """All columns, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]


def map_arrow(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` with batches bounded in bytes."""
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(kernel, schema)


def arrow_column(kernel: Callable, kind: str, *columns: Column) -> Column:
    """A column made by ``kernel`` from an iterator of Arrow arrays; batches as in ``map_arrow``."""
    bound_batches(SparkSession.active())
    kernel.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(kernel, kind)(*columns)


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``max_bytes`` of text each, at least one row.

    Bounds what a kernel holds beside the Arrow batch itself; a text is never cut.
    """
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > max_bytes:
            yield start, i
            start, held = i, 0
        held += size + 64
    if start < len(sizes):
        yield start, len(sizes)


def distinct_by_hash(rows: DataFrame, value: str, most: int, group: str | None = None) -> DataFrame:
    """Of each group the ``most`` distinct values of smallest hash, with column ``hash`` (a long).

    However often rows repeat, a value counts once. Only values that can be among the
    smallest are made distinct and ranked: a few more than are wanted, by each group's
    approximate number of distinct values; of a group with fewer, all.
    """
    names = free_prefix(rows, "_")
    key, place, share = f"{names}group", f"{names}place", f"{names}share"
    given = rows.select(
        F.lit(0).alias(key) if group is None else F.col(group).alias(key), F.col(value).alias(value), F.xxhash64(value).alias("hash")
    )
    number = F.approx_count_distinct("hash", 0.02)
    # The estimate is out by a tenth at most, but for once in millions.
    wanted = most + 8 * most**0.5
    same = f"{names}same"
    shares = given.groupBy(F.col(key).alias(same)).agg(F.least(F.lit(1.0), F.lit(wanted) / (0.9 * number)).alias(share))
    # Written for its true size: it is small, so no row of a large group moves for it.
    shares = stored(shares, "shares")
    fraction = F.col("hash") / F.lit(2.0**64) + 0.5
    ranked = F.row_number().over(Window.partitionBy(key).orderBy("hash", value))
    found = (
        given.join(shares, F.col(key).eqNullSafe(F.col(same)))
        .where(fraction <= F.col(share))
        .select(key, value, "hash")
        .distinct()
        .withColumn(place, ranked)
        .where(F.col(place) <= most)
    )
    return found.select(*([] if group is None else [F.col(key).alias(group)]), value, "hash")
