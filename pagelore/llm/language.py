"""Language identification by prediction by partial matching (operator 1)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute known)
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.byte_trees import build, count_strings, padded
from pagelore.llm.common import arrow_column, distinct_by_hash, map_arrow, stored, text_slices

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """The learned languages in order of name, and their trees in every task."""

    languages: list[str]
    trees: Broadcast

    def predict(self, text: Column) -> Column:
        """Struct ``lang_pred, score, bits_per_byte`` of a text.

        The language whose tree gives the whole text the shortest code; ``score`` is its
        probability if all languages are as likely beforehand (1 for one language).
        Equal lengths: the first in order of name. A text that is null or has no letter,
        or any text if nothing was learned: ``und``, 0 and null.
        """
        has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        if not self.languages:
            return F.struct(
                F.lit(UNDETERMINED).alias("lang_pred"),
                F.lit(0.0).alias("score"),
                F.lit(None).cast("double").alias("bits_per_byte"),
            )
        scored = arrow_column(
            _scorer(self.trees), "struct<best int, score double, bits double>", F.when(has_letter, text)
        )
        names = F.array(*map(F.lit, self.languages))
        return F.transform(
            F.array(scored),
            lambda s: F.struct(
                F.coalesce(F.get(names, s["best"]), F.lit(UNDETERMINED)).alias("lang_pred"),
                F.coalesce(s["score"], F.lit(0.0)).alias("score"),
                s["bits"].alias("bits_per_byte"),
            ),
        )[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 by 4. Null: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order: int = 4,
    sample_docs: int = 400,
    sample_doc_bytes: int = 65536,
    long_docs: int = 8,
    most_languages: int = 256,
) -> LanguageModel:
    """Byte trees of every language in ``labelled``.

    A bounded sample is learned from: of each language the ``sample_docs`` distinct texts of
    smallest hash among those of at most ``sample_doc_bytes`` bytes, whole; of a language
    without any such text, ``long_docs`` longer ones. However often rows or ids repeat, a
    text teaches once. Of more than ``most_languages`` labels the most frequent are learned.
    Rows whose text or language is null teach nothing. No such rows: no languages.
    """
    spark = labelled.sparkSession
    given = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    keyed = given.withColumn("key", F.xxhash64("text"))
    frequent = given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
    frequent = stored(frequent, "languages")
    # Texts stay where they are: hashes are sampled, and the sample's hashes fetch them.
    kind = F.struct("lang", (F.octet_length("text") > sample_doc_bytes).alias("long"))
    hashes = keyed.join(frequent, "lang", "left_semi").select(kind.alias("kind"), "key")
    keys = distinct_by_hash(hashes, "key", max(sample_docs, long_docs), "kind").select("kind.lang", "kind.long", "key", "hash")
    place = F.row_number().over(Window.partitionBy("lang", "long").orderBy("hash"))
    has_short = F.min("long").over(Window.partitionBy("lang")) == F.lit(False)
    keys = keys.withColumn("place", place).withColumn("has_short", has_short)
    taught = F.when(F.col("long"), ~F.col("has_short") & (F.col("place") <= long_docs)).otherwise(F.col("place") <= sample_docs)
    # At most most_languages * sample_docs rows.
    keys = stored(keys.where(taught).select("lang", "key"), "sample")
    sample = keyed.join(F.broadcast(keys), ["lang", "key"]).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for one in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == one)).cast(pa.binary())
                found, n = count_strings(iter(texts.to_pylist()), order)
                yield pa.record_batch(
                    {"lang": pa.array([one] * len(n), pa.string()), "string": found.astype(np.int64), "n": n}
                )

    counts = (
        map_arrow(sample, count, "lang string, string long, n long")
        .groupBy("lang", "string")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(pa.compute.unique(counts["lang"]).to_pylist())
    if not languages:
        return LanguageModel([], spark.sparkContext.broadcast(None))
    per_language = []
    for one in languages:
        own = counts.filter(pa.compute.equal(counts["lang"], one))
        per_language.append((own["string"].to_numpy().astype(np.uint64), own["n"].to_numpy()))
    trees = build(per_language, order)
    # As bytes: the classes travel with them, so executors need no copy of this package.
    return LanguageModel(languages, spark.sparkContext.broadcast(cloudpickle.dumps(trees)))


def _scorer(trees: Broadcast):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(trees.value)
        for texts in batches:
            best = np.full(len(texts), -1)
            score = np.zeros(len(texts))
            bits = np.zeros(len(texts))
            for low, high in text_slices(texts):
                given = texts.slice(low, high - low).cast(pa.binary()).to_pylist()
                at = [i for i, t in enumerate(given) if t]
                if not at:
                    continue
                text, starts = padded([given[i] for i in at], model.order)
                lengths = model.code_lengths(text, starts)
                at = low + np.array(at)
                least = lengths.min(axis=1)
                best[at] = lengths.argmin(axis=1)
                score[at] = 1 / np.exp2(least[:, None] - lengths).sum(axis=1)
                bits[at] = least / (np.diff(np.r_[starts, len(text)]) - model.order)
            none = best < 0
            yield pa.StructArray.from_arrays(
                [
                    pa.array(best.astype(np.int32), mask=none),
                    pa.array(score, mask=none),
                    pa.array(bits, mask=none),
                ],
                ["best", "score", "bits"],
            )

    return score


def identify(
    documents: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score, bits_per_byte``, one per row of ``documents``.

    Only the text decides. Repeated rows get equal answers; a null ``doc_id`` stays null;
    other columns are left out, whatever their names. No rows give no rows.
    """
    return documents.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), model.predict(F.col(text)).alias("found")
    ).select("doc_id", "held_out", "found.*")


def reject_unknown(
    documents: DataFrame,
    model: LanguageModel,
    text: str = "text",
    lang: str = "lang",
    min_score: float = 0.5,
    max_bits_per_byte: float = 8.0,
) -> DataFrame:
    """``documents`` in a language of the model, with ``lang`` set to it; all columns stay.

    Rejected: ``und``, a score below ``min_score``, and texts that no language describes
    better than plain bytes (``max_bits_per_byte``). Null texts are rejected, repeated
    rows stay repeated. No rows give no rows.
    """
    found = "__found"
    while found in documents.columns:
        found += "_"
    judged = documents.withColumn(found, model.predict(F.col(text)))
    good = (
        (F.col(f"{found}.lang_pred") != UNDETERMINED)
        & (F.col(f"{found}.score") >= min_score)
        & (F.col(f"{found}.bits_per_byte") < max_bits_per_byte)
    )
    return judged.where(good).withColumn(lang, F.col(f"{found}.lang_pred")).drop(found)
