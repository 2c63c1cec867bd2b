"""Prompts: user names, the one-off user message and the message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.names import clean_username, pseudonym


def user_message(question: Column, context: Column, username: Column) -> Column:
    """The user message of a one-off question."""
    # Fixed value: the message layout. Only a missing name becomes N/A.
    return F.concat(
        F.lit("Information:\n"),
        context,
        F.lit("\n\n\n---\n\n\nQuestion: "),
        question,
        F.lit("\nUsername: "),
        F.coalesce(username, F.lit("N/A")),
        F.lit("\n"),
    )


def followup_message(question: Column, context: Column) -> Column:
    """The user message that replaces the last question of a conversation."""
    # Fixed value: the message layout.
    return F.concat(F.lit("Question: "), question, F.lit("\n\nInformation:\n"), context)


def message_list(system_text: str) -> Column:
    """``array<struct<role, text, participant>>`` of a prepared request."""
    name = clean_username(F.col("username"))
    system = F.struct(
        F.lit("system").alias("role"),
        F.lit(system_text).alias("text"),
        F.lit(None).cast("string").alias("participant"),
    )
    user = F.struct(
        F.lit("user").alias("role"),
        user_message(F.col("prompt"), F.col("context"), name).alias("text"),
        pseudonym(name).alias("participant"),
    )
    return F.array(system, user)


def messages(prepared: DataFrame, system_text: str) -> DataFrame:
    """``request_id, position, role, text, participant`` of every request that may go on."""
    listed = prepared.where("status = 'ok'").select(
        "request_id", F.posexplode_outer(message_list(system_text)).alias("position", "message")
    )
    return listed.select("request_id", "position", "message.role", "message.text", "message.participant")
