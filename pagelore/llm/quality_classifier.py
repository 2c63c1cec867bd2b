"""Quality of texts from learned subword vectors (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import arrow_column, distinct_by_hash, text_slices
from pagelore.llm.language import held_out
from pagelore.llm.subword_vectors import Scorer, train

# Most bytes of a text that teaches, and of one that teaches where a class has no such text.
SAMPLE_BYTES, LONG_BYTES = 1 << 15, 1 << 20


def learn_quality(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_texts: int = 1500,
) -> Scorer:
    """Subword vectors of labelled texts (1 good, 0 bad), learned in numpy on a bounded sample.

    Of each class the ``sample_texts`` distinct texts of smallest hash teach, among those of
    ``SAMPLE_BYTES`` at most; of a class without any, eight of at most ``LONG_BYTES``. A document
    labelled more than once has the label of most; held as often, none. Other label values
    and documents without an id or a label teach nothing; null texts teach as empty ones. The
    odds are shifted by the numbers of labelled documents. Without labels of one class every
    text is of the other; without any, the odds are even.
    """
    votes = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("mean"))
    votes = votes.where("mean <> 0.5").select("id", (F.col("mean") > 0.5).cast("int").alias("class"))
    given = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("text"))
    # Texts stay where they are: labels meet their hashes, and the sample's hashes fetch them.
    size = F.octet_length("text")
    taught = given.select("id", "key", size.alias("size")).join(votes, "id")
    numbers = dict(taught.groupBy("class").count().collect())
    if len(numbers) < 2:
        return Scorer(np.zeros(1), math.inf * (1 if 1 in numbers else -1) if numbers else 0.0)
    kind = F.struct("class", (F.col("size") > SAMPLE_BYTES).alias("long"))
    keys = distinct_by_hash(taught.where(F.col("size") <= LONG_BYTES).withColumn("kind", kind), "key", sample_texts, "kind")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("hash"))
    keys = keys.withColumn("place", place).where(~F.col("kind.long") | (F.col("place") <= 8))
    # At most 2 * (sample_texts + 8) rows.
    sample = given.where(size <= LONG_BYTES).join(F.broadcast(keys.select("key", "kind")), "key").select("kind", "text").distinct()
    rows = sample.select("kind.class", "kind.long", "text").collect()
    short = {r["class"] for r in rows if not r["long"]}
    rows = sorted((r["class"], r["text"]) for r in rows if not r["long"] or r["class"] not in short)
    return train([t for _, t in rows], [c for c, _ in rows], math.log(numbers[1] / numbers[0]))


def score_quality(
    documents: DataFrame, model: Scorer, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``, one per row of ``documents``.

    Only the text decides, whole. A null text scores as an empty one; repeated rows get equal
    scores; a null ``doc_id`` stays null. Other columns are left out, whatever their names. No rows give
    no rows.
    """
    known = documents.sparkSession.sparkContext.broadcast((model.moves, model.shift))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*known.value)
        for texts in batches:
            found = []
            for low, high in text_slices(texts):
                found += [scorer.score(t) for t in texts.slice(low, high - low).to_pylist()]
            yield pa.array(found, pa.float64())

    scored = documents.select(
        F.col(doc_id).alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        arrow_column(score, "double", F.coalesce(F.col(text), F.lit(""))).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
