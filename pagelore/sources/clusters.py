"""Vectors laid out by direction, so that an exact search can leave most of them unread.

Each vector lies in the folder of its nearest centre; ``blocks`` tells of each centre how
many vectors it has and the widest angle to one of them. A vector that cannot be ranked
(null, zero or not finite) is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelore.operators.topk_kernel import matrix, unit_rows

CLUSTERS = 1024

# Distinct vectors that centres are learned from, for each centre.
_SAMPLE = 16
_ROUNDS = 5
_ROWS = 4096


def write_clusters(points: DataFrame, path: str, clusters: int = CLUSTERS) -> None:
    """Write ``id, embedding`` below ``path``, in at most ``clusters`` folders.

    The centres are learned on a sample (16 distinct vectors for each centre). Vectors are
    shuffled once; a folder that gets very many is written by several tasks.
    """
    spark = points.sparkSession
    path = path.rstrip("/")
    vectors = points.select("id", "embedding").where("embedding is not null")
    shared = spark.sparkContext.broadcast(_centres(vectors, clusters))
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, embedding array<float>, cluster int, angle double"
    schema = spark.createDataFrame([], schema).schema
    arrow_schema = to_arrow_schema(schema)

    def located(batches):
        centres = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                yield from _located(batch.slice(start, _ROWS), centres, arrow_schema)

    rows = vectors.select("id", F.col("embedding").cast("array<float>")).mapInArrow(located, schema)
    rows.hint("rebalance", "cluster").write.mode("errorifexists").partitionBy("cluster").parquet(f"{path}/vectors")
    centres = spark.createDataFrame(
        [(i, centre.tolist()) for i, centre in enumerate(shared.value)], "cluster int, centre array<double>"
    )
    found = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cluster")
    found = found.agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("id").alias("first_id"))
    found.join(F.broadcast(centres), "cluster").coalesce(1).write.parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, n, radius, first_id, centre``: a row for each folder."""
    return spark.read.parquet(f"{path.rstrip('/')}/blocks")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``id, embedding, angle, cluster``."""
    known = read_blocks(spark, path).schema
    # Told, because folders without any file tell nothing.
    schema = T.StructType(
        [
            T.StructField("id", known["first_id"].dataType),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("angle", T.DoubleType()),
            T.StructField("cluster", T.IntegerType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/vectors")


def _centres(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Unit vectors, from those of the smallest hashes among the distinct ones."""
    wanted = clusters * _SAMPLE
    hashed = vectors.select(F.xxhash64("embedding").alias("hash"), "embedding")
    distinct = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    if distinct > 2 * wanted:
        # Twice as many as wanted, so that an estimate will do.
        hashed = hashed.where(F.col("hash") < -(1 << 63) + int((1 << 64) * 2 * wanted / distinct))
    sample = hashed.dropDuplicates(["hash"]).orderBy("hash").limit(wanted).toArrow()["embedding"].combine_chunks()
    if not len(sample):
        return np.empty((0, 0))
    units, usable = unit_rows(matrix(sample, len(sample[0])))
    units = units[usable]
    centres = units[:clusters]
    for _ in range(_ROUNDS if len(units) > clusters else 0):
        nearest = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        moved, some = unit_rows(sums)
        centres = np.where(some[:, None], moved, centres)
    return centres


def _located(batch: pa.RecordBatch, centres: np.ndarray, schema: pa.Schema):
    embedding = batch["embedding"]
    dim = centres.shape[1] if len(centres) else len(embedding[0])
    units, usable = unit_rows(matrix(embedding, dim))
    if not usable.any():
        return
    kept = pa.array(np.flatnonzero(usable))
    cosines = units[usable] @ centres.T
    cluster = np.argmax(cosines, axis=1)
    angle = np.arccos(np.clip(cosines[np.arange(len(cluster)), cluster], -1, 1))
    columns = [batch["id"].take(kept), embedding.take(kept), pa.array(cluster, pa.int32()), pa.array(angle)]
    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
