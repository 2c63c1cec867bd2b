"""Exact top-k over vectors laid out by direction: most folders are never read.

A question first sees the nearest folders that together have ``k`` vectors. The ``k``-th
score found there is a floor. By the triangle inequality no vector of a folder is nearer to
the question than the angle to its centre less the folder's radius, so of the other folders
only those are read in which the floor can be reached. The result is that of
:func:`pagelore.operators.retrieve.top_k_batch`, ties included.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelore.operators.ranking import rank_hits
from pagelore.operators.retrieve import PASS_BYTES, asked_once, hit_schema, in_passes, measure, scan_tasks
from pagelore.operators.topk_kernel import matrix, score_clusters, unit_rows
from pagelore.sources.clusters import read_blocks, read_vectors

# More than rounding can move an angle, or a score.
_SLACK = 2e-6
# Questions times folders held at once.
_CELLS = 4_000_000


def top_k_clustered(spark: SparkSession, path: str, questions: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``question_id, rank, score, id`` of the ``k`` nearest of the vectors that ``write_clusters`` wrote.

    Ids of questions are unique.
    """
    vectors = read_vectors(spark, path)
    schema = hit_schema(vectors, questions)
    asked = near_folders(asked_once(questions), read_blocks(spark, path)).checkpoint()
    measured = measure(asked, "clusters")
    if measured["bytes"] is None:
        return rank_hits(spark.createDataFrame([], schema), 0).drop("k")
    first = _search(vectors, asked, schema, pass_bytes)
    first = rank_hits(first, measured["most"]).select(schema.names).checkpoint()
    more = further_folders(asked, first, read_blocks(spark, path)).checkpoint()
    found = first.union(_search(vectors, more, schema, pass_bytes))
    return rank_hits(found, measured["most"]).drop("k")


def near_folders(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``clusters``, the nearest that have ``k`` vectors together, and a ``floor`` that bars nothing."""

    def nearest(angles, blocks, questions):
        order = np.argsort(angles, axis=1, kind="stable")
        before = np.cumsum(blocks["n"][order], axis=1) - blocks["n"][order]
        for row, k in enumerate(questions["k"].to_numpy()):
            yield blocks["cluster"][order[row, before[row] < k]]

    return _with_folders(asked.withColumn("floor", F.lit(float("-inf"))), blocks, nearest)


def further_folders(asked: DataFrame, hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """``clusters`` that were not read and may reach the ``floor`` that the hits set."""

    def reachable(angles, blocks, questions):
        best = np.cos(np.maximum(angles - blocks["radius"] - _SLACK, 0))
        reaches = best + _SLACK >= questions["floor"].to_numpy()[:, None]
        for row, seen in enumerate(questions["seen"].to_pylist()):
            yield np.setdiff1d(blocks["cluster"][reaches[row]], seen)

    found = hits.groupBy("question_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(float("-inf"))
    known = asked.withColumnRenamed("clusters", "seen").drop("floor").join(found, "question_id", "left")
    known = known.withColumn("floor", floor).drop("n", "least")
    return _with_folders(known, blocks, reachable).drop("seen").where("size(clusters) > 0")


def _with_folders(questions: DataFrame, blocks: DataFrame, choose) -> DataFrame:
    """Add ``clusters``, chosen by the angles to the centres; a question without direction gets none."""
    spark = questions.sparkSession
    # A row for each folder: as many as were asked for when they were written.
    table = blocks.orderBy("cluster").toArrow()
    known = {name: table[name].to_numpy() for name in ("cluster", "n", "radius")}
    if table.num_rows:
        centres = table["centre"].combine_chunks()
        known["centre"] = matrix(centres, len(centres[0]))
    shared = spark.sparkContext.broadcast(known)
    schema = T.StructType([*questions.schema, T.StructField("clusters", T.ArrayType(T.IntegerType()))])
    arrow_schema = to_arrow_schema(schema)

    def with_folders(batches):
        blocks = shared.value
        step = max(1, _CELLS // max(1, len(blocks["cluster"])))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = [()] * part.num_rows
                if "centre" in blocks:
                    units, usable = unit_rows(matrix(part["embedding"], blocks["centre"].shape[1]))
                    angles = np.arccos(np.clip(units @ blocks["centre"].T, -1, 1))
                    chosen = choose(angles, blocks, part)
                    lists = [found if there else () for found, there in zip(chosen, usable)]
                columns = [*part.columns, pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return questions.mapInArrow(with_folders, schema)


def _search(vectors: DataFrame, questions: DataFrame, schema: T.StructType, pass_bytes: int) -> DataFrame:
    measured = measure(questions, "clusters")
    none = vectors.sparkSession.createDataFrame([], schema)
    if measured["bytes"] is None:
        return none
    parts = in_passes(questions, measured, pass_bytes)
    return reduce(DataFrame.union, [_scan(vectors, part.toArrow(), schema) for part in parts], none)


def _scan(vectors: DataFrame, questions: pa.Table, schema: T.StructType) -> DataFrame:
    """The best of each question in the folders it names; no other folder is read."""
    spark = vectors.sparkSession
    folders = np.unique(questions["clusters"].combine_chunks().flatten().to_numpy()).tolist() if questions.num_rows else []
    if not folders:
        return spark.createDataFrame([], schema)
    arrow_schema = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(questions)

    def score(batches):
        return score_clusters(batches, shared.value, arrow_schema)

    there = vectors.where(F.col("cluster").isin(folders)).select("id", "embedding", "cluster")
    return there.coalesce(scan_tasks(spark)).mapInArrow(score, schema)
