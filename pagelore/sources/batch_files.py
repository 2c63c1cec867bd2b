"""Batch embedding as files: request lines out, result lines in, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.rows import computed_once

# What a request line says besides its key and text.
_METHOD = "POST"
_URL = "/v1/embeddings"

_RESULT = (
    "struct<custom_id:string,"
    "response:struct<body:struct<data:array<struct<embedding:array<float>>>>>>"
)


def batch_requests(chunks: DataFrame, model: str, key: str = "title") -> DataFrame:
    """``custom_id, method, url, body`` per chunk; ``key`` names the chunk's unique column."""
    body = F.create_map(F.lit("input"), F.col("content"), F.lit("model"), F.lit(model))
    return chunks.select(
        F.col(key).cast("string").alias("custom_id"),
        F.lit(_METHOD).alias("method"),
        F.lit(_URL).alias("url"),
        body.alias("body"),
    )


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON object per line; an empty batch is an error."""
    if requests.isEmpty():
        raise ValueError("there are no requests to write")
    line = F.to_json(F.struct("custom_id", "method", "url", "body"))
    requests.select(line.alias("value")).write.mode("overwrite").text(path)


def parse_results(lines: DataFrame) -> DataFrame:
    """``custom_id, embedding`` from JSON lines in ``value`` (batch or stream)."""
    return lines.select(computed_once(F.from_json("value", _RESULT).alias("r"))).select(*_fields("r."))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``custom_id, embedding`` of a directory of JSON result lines."""
    fields = _RESULT.removeprefix("struct<").removesuffix(">").replace(":struct", " struct", 1)
    schema = fields.replace("custom_id:string", "custom_id string", 1)
    return spark.read.schema(schema).json(path).select(*_fields(""))


def _fields(prefix: str) -> list[Column]:
    first = F.get(F.col(f"{prefix}response.body.data"), F.lit(0))
    return [
        F.col(f"{prefix}custom_id").alias("custom_id"),
        first["embedding"].alias("embedding"),
    ]


def attach_embeddings(
    chunks: DataFrame, results: DataFrame, key: str = "title", strict: bool = True
) -> DataFrame:
    """Chunks with the embedding of the result that carries their key; one row for each chunk.

    Strict: a chunk without a result, one with two, and a result without a key fail the
    job. Lenient: the first keeps a null embedding (:func:`missing_results` lists them),
    the second any one of its results, and the third is left out.
    """
    given_key = F.col("custom_id")
    if strict:
        given_key = F.coalesce(given_key, F.raise_error(F.lit("a batch result without custom_id")).cast("string"))
    found = results.groupBy(given_key.alias("_key")).agg(
        F.any_value("embedding", F.lit(True)).alias("embedding"), F.count("*").alias("_n")
    )
    joined = chunks.join(found, F.col(key).cast("string") == F.col("_key"), "left")
    if strict:
        name = F.col(key).cast("string")
        missing = F.raise_error(F.concat(F.lit("no embedding for "), name))
        double = F.raise_error(F.concat(F.lit("more than one embedding for "), name))
        vector = (
            F.when(F.col("embedding").isNull(), missing).when(F.col("_n") > 1, double).otherwise(F.col("embedding"))
        )
    else:
        vector = F.col("embedding")
    return joined.select(*chunks.columns, vector.alias("embedding"))


def missing_results(chunks: DataFrame, results: DataFrame, key: str = "title") -> DataFrame:
    """Chunks without a usable result."""
    found = results.where("embedding is not null").select(F.col("custom_id").alias("_key"))
    return chunks.join(found, F.col(key).cast("string") == F.col("_key"), "left_anti")


def batch_progress(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One row: ``total, completed, done``. Only the keys are read and joined."""
    answered = results.where("embedding is not null").select("custom_id").distinct()
    answered = answered.withColumn("answered", F.lit(True))
    return (
        requests.select("custom_id")
        .join(answered, "custom_id", "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count("answered").alias("completed"))
        .withColumn("done", F.col("total") == F.col("completed"))
    )
