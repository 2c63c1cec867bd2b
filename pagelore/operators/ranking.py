"""Ranks of hits per question, also where a question has more than one task should sort.

Hits are ``question_id, id, score, k``. Few hits a question: one window. Small ``k``: two windows,
the first per question and salt. Large ``k``: the hits are selected and then sorted over all tasks, question by
question in ranges that end inside a question where it is long, and each range is told
how many of its first question's hits lie in ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.session import use_checkpoints

# Up to this ``k`` one task sorts all that is left of a question.
WINDOW_K = 100_000

_MERGE_SALTS = 16
# Scores between -1 and 1 are counted in so many steps a unit to find where the k-th may lie.
_STEPS = 1000


def rank_hits(hits: DataFrame, most: int, window_k: int = WINDOW_K, scans: int | None = None) -> DataFrame:
    """``question_id, rank, score, id, k`` of each question's best ``k``; ties go to the smaller id.

    ``most`` is the largest ``k``; beyond ``window_k`` no task gets all hits of a question.
    ``scans`` is how many tasks found up to ``k`` hits of a question each, if that is known: where
    one task may sort them all, they are shuffled once. A question has an id, and hits have a score.
    """
    if scans is not None and most * scans <= window_k:
        ranked = _ranked_by_one_window(hits)
    else:
        ranked = _ranked_by_windows(hits) if most <= window_k else _ranked_by_ranges(hits)
    return ranked.where("rank <= k").select("question_id", "rank", "score", "id", "k")


def _order(window):
    return window.orderBy(F.desc("score"), F.col("id"))


def _ranked_by_one_window(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_order(Window.partitionBy("question_id"))))


def _ranked_by_windows(hits: DataFrame) -> DataFrame:
    salt = F.pmod(F.hash("id"), F.lit(_MERGE_SALTS))
    place = F.row_number().over(_order(Window.partitionBy("question_id", "salt")))
    return _ranked_by_one_window(hits.withColumn("salt", salt).withColumn("place", place).where("place <= k"))


def _ranked_by_ranges(hits: DataFrame) -> DataFrame:
    use_checkpoints(hits.sparkSession)
    # Written once: hits are counted, selected and sampled for the ranges.
    near = _selected(hits.checkpoint())
    schema = T.StructType([*near.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    ranges = (
        near.repartitionByRange("question_id", F.desc("score"), "id")
        .sortWithinPartitions("question_id", F.desc("score"), "id")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_numbered, schema)
        # The numbers of the ranges are told to rows of other ranges: they must not change any more.
        .checkpoint()
    )
    # A row for each question and for each range more that it reaches into: few.
    ends = ranges.groupBy("question_id", "part").agg(F.max("place").alias("n"))
    before = Window.partitionBy("question_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("question_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Only a question's second and further ranges have hits before them.
    further = offsets.where("offset > 0")
    rank = F.col("place") + F.coalesce("offset", F.lit(0))
    return ranges.join(further, ["question_id", "part"], "left").withColumn("rank", rank.cast("int"))


def _selected(hits: DataFrame) -> DataFrame:
    """The hits down to the step of scores in which a question's ``k``-th lies, that step included."""
    step = F.floor((1 - F.col("score")) * _STEPS)
    stepped = hits.withColumn("step", step)
    counts = stepped.groupBy("question_id", "step").agg(F.count("*").alias("n"), F.max("k").alias("most"))
    so_far = Window.partitionBy("question_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("better", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where("better < most")
    last = reached.groupBy("question_id").agg(F.max("step").alias("last"))
    return stepped.join(last, "question_id").where("step <= last").select(hits.columns)


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each question in a sorted range from 1."""
    question, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["question_id"]
        starts = pc.not_equal(ids[1:], ids[:-1])
        starts = np.concatenate([[ids[0].as_py() != question], starts.to_numpy(zero_copy_only=False)]).astype(bool)
        rows = np.arange(batch.num_rows)
        # The first row of the question each row belongs to; one that goes on began ``count`` rows earlier.
        first = np.maximum.accumulate(np.where(starts, rows, -1))
        places = np.where(first < 0, count + rows + 1, rows - first + 1)
        question, count = ids[-1].as_py(), int(places[-1])
        yield batch.append_column("place", pa.array(places, pa.int64()))
