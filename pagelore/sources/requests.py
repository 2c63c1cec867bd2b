"""Ask and chat requests in, responses out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.rows import computed_once
from pagelore.functions.text import trim
from pagelore.operators.retrieve import DEFAULT_K

# Fixed value: the model named by a request that names none.
DEFAULT_MODEL = "gpt-4o-mini"

_MAX_BIGINT = (1 << 63) - 1


def parse_requests(lines: DataFrame) -> DataFrame:
    """Requests from JSON objects in ``value`` (a batch or a stream of lines).

    Field names count without regard to case, as ``requestId, prompt, model,
    username, maxLength, maxContextLength``; numbers may be quoted. A line that is
    no object, lacks its id or holds a bad number gets ``parse_error`` and stays.
    """
    entries = F.map_entries(F.from_json("value", "map<string,string>"))

    def field(name: str) -> Column:
        named = F.filter("entries", lambda e: F.lower(F.replace(e["key"], F.lit("_"), F.lit(""))) == name)
        return F.try_element_at(named, F.lit(-1))["value"].alias(name)

    names = ("requestid", "prompt", "model", "username", "maxlength", "maxcontextlength")
    read = lines.select(computed_once(entries.alias("entries"))).select(computed_once(*map(field, names)))
    # Wide enough for any unsigned 64-bit number; more points than a bigint can
    # count are as many as the largest bigint.
    context_length = F.col("maxcontextlength").try_cast("decimal(20,0)")
    raw = read.select(
        F.col("requestid").alias("request_id"),
        "prompt",
        "model",
        "username",
        F.col("maxlength").try_cast("int").alias("max_length"),
        F.when(context_length.isNotNull(), F.least(context_length, F.lit(_MAX_BIGINT)))
        .cast("bigint")
        .alias("max_context_length"),
        (
            F.col("requestid").isNull()
            | _unreadable(F.col("maxlength"), "int")
            | _unreadable(F.col("maxcontextlength"), "decimal(20,0)")
            | F.coalesce(context_length < 0, F.lit(False))
        ).alias("parse_error"),
    )
    return read_requests(raw)


def parse_conversations(lines: DataFrame) -> DataFrame:
    """``conv_id, conversation`` from JSON objects in ``value`` (a batch or a stream).

    Fields are ``conversationId`` and ``conversation``, a list of ``role, message``. A
    line that cannot be read has a null conversation.
    """
    payload = "struct<conversationId:string,conversation:array<struct<role:string,message:string>>>"
    read = lines.select(computed_once(F.from_json("value", payload).alias("payload")))
    return read.select(
        F.col("payload.conversationId").alias("conv_id"), F.col("payload.conversation").alias("conversation")
    )


def _unreadable(value: Column, kind: str) -> Column:
    return value.isNotNull() & (value.try_cast(kind).isNull() | value.contains("."))


def read_requests(requests: DataFrame) -> DataFrame:
    """Requests with types fixed and defaults filled; optional columns may be absent."""

    def given(name: str, kind: str) -> Column:
        column = F.col(name) if name in requests.columns else F.lit(None)
        return column.cast(kind)

    return requests.select(
        "request_id",
        given("prompt", "string").alias("prompt"),
        F.coalesce(given("model", "string"), F.lit(DEFAULT_MODEL)).alias("model"),
        given("username", "string").alias("username"),
        given("max_length", "int").alias("max_length"),
        F.coalesce(given("max_context_length", "bigint"), F.lit(DEFAULT_K)).alias("max_context_length"),
        F.coalesce(given("parse_error", "boolean"), F.lit(False)).alias("parse_error"),
    )


def to_responses(answered: DataFrame, version: str, started_ms: int | None = None) -> DataFrame:
    """Response rows: every field of the response as a string, plus the outcome.

    With ``started_ms`` (epoch) ``duration`` is the time until a row was produced.
    """
    ok = F.col("status") == "ok"
    if started_ms is None:
        duration = F.lit(None).cast("string")
    else:
        now = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint")
        duration = F.when(ok, F.greatest(now - started_ms, F.lit(0)).cast("string"))
    return answered.select(
        "request_id",
        "status",
        "reason",
        "error",
        F.when(ok, trim(F.col("completion"))).alias("answer"),
        F.when(ok, F.col("context")).alias("context"),
        duration.alias("duration"),
        F.when(ok, F.lit(version)).alias("version"),
        F.when(ok, F.col("question_tokens").cast("string")).alias("question_tokens"),
        F.when(ok, F.col("response_tokens").cast("string")).alias("response_tokens"),
    )


def write_answers(responses: DataFrame, path: str) -> None:
    """Replace the responses at ``path``."""
    responses.write.mode("overwrite").parquet(path)


def write_answer_lines(responses: DataFrame, path: str) -> None:
    """Responses, of questions or of conversations, as JSON lines with the field names of the service."""
    responses.select(F.to_json(F.struct(*responses.columns)).alias("value")).write.mode("overwrite").text(path)
