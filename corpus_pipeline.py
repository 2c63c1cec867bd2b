"""The training-data pipeline: from raw documents to packed token windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelore.llm.common import every_column, free_prefix, stored, table
from pagelore.llm.language import held_out, learn, reject_unknown
from pagelore.llm.mixing import mix
from pagelore.llm.near_copies import keep_one
from pagelore.llm.quality import clean
from pagelore.llm.queries import WEIGHTS, levels, packed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` set to it."""
    return reject_unknown(docs, learn(docs.where(~held_out())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, shared out by the weights of domains, languages and sources."""
    return mix(docs, levels(), WEIGHTS, percent=80, prefix=free_prefix(docs, "_")).select(every_column(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Byte models and differencing cannot be told in SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
