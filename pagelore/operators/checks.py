"""Per-request checks: an outcome column instead of an exception.

Rows carry ``status`` (``ok`` or ``rejected``), ``reason`` and ``error``. The first
rejection stands; a rejected row stays in the table and takes no further part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.text import is_blank

# The message of each rejection.
ERRORS = {
    "malformed_request": "The request could not be read.",
    "blank_question": "The question cannot be empty.",
    "zero_max_tokens": "The maximum output token count cannot be 0",
    "flagged_input": "The question was flagged by the moderation API",
    "flagged_output": "The question was flagged by the moderation API",
    "no_user_turn": "The conversation has no user message.",
    "duplicate_completion": "There is more than one completion for this request.",
    "no_completion": "There is no completion for this request.",
}


def check_prompt(prompt: Column) -> Column:
    return F.when(is_blank(prompt), F.lit("blank_question"))


def check_limit(max_length: Column) -> Column:
    return F.when(max_length == 0, F.lit("zero_max_tokens"))


def with_outcome(rows: DataFrame, reason: Column) -> DataFrame:
    """Set the outcome from ``reason`` (null: fine); an earlier rejection is kept."""
    if "reason" in rows.columns:
        reason = F.coalesce(F.col("reason"), reason)
    texts = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return (
        rows.withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))
        .withColumn("error", F.try_element_at(texts, F.col("reason")))
    )


def validate(requests: DataFrame) -> DataFrame:
    """Outcome of reading the request, of its question and of its output limit."""
    unread = F.when(F.col("parse_error"), F.lit("malformed_request"))
    return with_outcome(
        requests, F.coalesce(unread, check_prompt(F.col("prompt")), check_limit(F.col("max_length")))
    )


def split_outcome(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may go on, and the rejects."""
    return rows.where("status = 'ok'"), rows.where("status <> 'ok'")
