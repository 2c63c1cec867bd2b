"""The points table: rebuilt as a whole, kept as immutable versions, laid out by id.

A rebuild writes a new directory, then takes the next version number by creating a file of
that name, which only one of several rebuilds can, and appends one row to the ``commits``
table. Readers resolve a version through that table, so they see the old points until the
new ones are complete, and every earlier version stays readable.

Points lie in buckets, which are ranges of their ids: whoever looks points up by id reads
only the buckets of those ids (see :func:`bucket_of`).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions.vectors import norm
from pagelore.session import create_exclusively

_COMMITS = "version bigint, location string, dim int, committed_at timestamp, buckets int"


def rebuild(
    points: DataFrame,
    path: str,
    dim: int,
    key: tuple[str, ...] = ("page_id", "chunk_no"),
    random_ids: bool = False,
    buckets: int | None = None,
) -> int:
    """Write ``title, content, tokens, embedding`` under new ids, with each vector's norm; returns the version.

    Ids are UUIDs hashed from ``key``, so that a retried task writes the same rows
    and ties rank alike after a rebuild; ``random_ids`` draws them instead. Rows of one key
    (a page that comes twice) are points of their own: the second and further ones, in order
    of title and content, get ids of their own in the same bucket. A vector that is missing or
    not ``dim`` wide fails the write.

    Points are shuffled once, by bucket, and written with zstd, since they are mostly text. There are as many buckets as shuffle partitions
    unless told; a lookup reads at least one bucket, so let one be about a gigabyte.
    """
    spark = points.sparkSession
    path = path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    location = f"{path}/data/{uuid.uuid4().hex}"
    width = F.coalesce(F.size("embedding"), F.lit(-1))
    fits = F.when(width == dim, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} values, found "), width.cast("string"))).cast("array<float>")
    )
    rows = points.select(
        (F.uuid() if random_ids else _stable_id(key)).alias("id"),
        "title",
        "content",
        F.col("tokens").cast("int").alias("tokens"),
        fits.alias("embedding"),
    )
    # Dealt out by number: by hash, some tasks would get several buckets and others none.
    tasks = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartitionById(tasks, "bucket")
    # Sorted by bucket first, as the write wants it, and rows of one id meet in their bucket.
    same = Window.partitionBy("bucket", "id").orderBy("title", "content", "tokens", "embedding")
    rows = rows.withColumn("number", F.row_number().over(same))
    further = F.concat(F.substring("id", 1, 8), F.substring(_uuid(F.md5(F.concat_ws(":", "id", "number"))), 9, 28))
    rows.select(
        F.when(F.col("number") == 1, F.col("id")).otherwise(further).alias("id"),
        "title",
        "content",
        "tokens",
        "embedding",
        norm(F.col("embedding")).alias("norm"),
        "bucket",
    ).write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(location)
    version = (snapshots(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    while not create_exclusively(spark, f"{path}/versions/{version}"):
        version += 1
    commit = spark.range(0, 1, 1, 1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(location).alias("location"),
        F.lit(dim).alias("dim"),
        F.current_timestamp().alias("committed_at"),
        F.lit(buckets).alias("buckets"),
    )
    commit.write.mode("append").parquet(f"{path}/commits")
    return version


def bucket_of(point_id: Column, buckets: int) -> Column:
    """The bucket of an id: the range, one of ``buckets`` equal ones, that its first eight hex digits fall in."""
    return F.floor(F.conv(F.substring(point_id, 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("int")


def buckets_of(points: DataFrame) -> int | None:
    """How many buckets the points of :func:`read_points` lie in; None of others."""
    return points.schema["bucket"].metadata.get("buckets") if "bucket" in points.columns else None


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``version, location, dim, committed_at`` of every complete version."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def read_points(
    spark: SparkSession, path: str, version: int | None = None, vectors: bool = True, location: str | None = None
) -> DataFrame:
    """The points of a version, by default the latest; payload only without ``vectors``.

    With vectors come each one's ``norm`` and its ``bucket``. ``location`` (see
    :func:`snapshots`) names a version by its folder.
    """
    known = snapshots(spark, path)
    if location is not None:
        known = known.where(F.col("location") == location)
    if version is not None:
        known = known.where(F.col("version") == version)
    latest = known.orderBy(F.desc("version"), F.desc("committed_at")).first()
    if latest is None:
        raise LookupError(f"no version {'' if version is None else version} at {path}")
    points = spark.read.parquet(latest.location)
    if not vectors:
        return points.select("id", "title", "content", "tokens")
    if latest.buckets is None:  # written before there was a layout
        return points
    told = F.col("bucket").alias("bucket", metadata={"buckets": latest.buckets})
    return points.select("id", "title", "content", "tokens", "embedding", "norm", told)


def _stable_id(key: tuple[str, ...]) -> Column:
    return _uuid(F.md5(F.to_json(F.array(*[F.col(name).cast("string") for name in key]))))


def _uuid(digest: Column) -> Column:
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
