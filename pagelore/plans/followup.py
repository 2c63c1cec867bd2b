"""Follow-up questions: the last question of a conversation, answered in context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.answers import Completer, attach_completions
from pagelore.operators.checks import check_limit, check_prompt, with_outcome
from pagelore.operators.conversation import (
    known_roles,
    message,
    nest_turns,
    nested_known_roles,
    nested_last_user,
    nested_rewrite,
    rewrite_asked,
    summarise,
)
from pagelore.operators.embed import Embedder, embedding
from pagelore.operators.moderate import Moderator, gate
from pagelore.operators.retrieve import DEFAULT_K, build_context, retrieve
from pagelore.session import use_checkpoints


class FollowUp(NamedTuple):
    """``turns`` of the answered conversations, and the outcome of every one."""

    turns: DataFrame
    outcomes: DataFrame


def follow_up(
    turns: DataFrame,
    points: DataFrame,
    *,
    embedder: Embedder,
    dim: int,
    system_text: str,
    completions: DataFrame | Completer,
    input_verdicts: DataFrame | Moderator | None = None,
    output_verdicts: DataFrame | Moderator | None = None,
    given_contexts: DataFrame | None = None,
    limits: DataFrame | None = None,
) -> FollowUp:
    """Follow-up over turn rows, for tables of any number and length of conversations.

    Completions, verdict tables, ``given_contexts`` (``conv_id, context``) and ``limits``
    (``conv_id`` and ``max_length``, perhaps ``model``) are keyed by ``conv_id``. Where a
    context is given, nothing is retrieved; a limit of 0 is rejected. Every conversation has
    one outcome, one of unknown roles only included.

    Turns are never gathered, unless ``completions`` is a function: it is told the limit, the
    model and the whole conversation, which is one row then, once for each that may go on.
    """
    spark = turns.sparkSession
    summaries = _with_limits(_with_given(summarise(turns), given_contexts), limits)
    turns = known_roles(turns)
    checked = _check(summaries, F.col("question.text"), input_verdicts)
    by_function = not isinstance(completions, DataFrame)
    use_checkpoints(spark)
    if by_function:
        # Whoever passed the input gate is read by retrieval and by the prompt.
        checked = checked.checkpoint()
        asked = checked.where("status = 'ok'")
        contexts = _contexts(asked, F.col("question.text"), points, embedder, dim).checkpoint()
        rewritten = rewrite_asked(turns, asked.drop("given_context"), contexts, system_text)
        sent = nest_turns(rewritten).withColumnRenamed("conversation", "messages")
        checked = checked.join(sent, "conv_id", "left")
        told = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["message"].alias("text")))
        answered = attach_completions(checked, completions, "conv_id", told).drop("messages")
    else:
        answered = attach_completions(checked, completions, "conv_id")
    outcomes = gate(answered, output_verdicts, "conv_id", "completion", "output")
    # A row per conversation, read by retrieval and by every part of the result.
    outcomes = outcomes.checkpoint()
    asked = outcomes.where("status = 'ok'")
    if not by_function:
        contexts = _contexts(asked, F.col("question.text"), points, embedder, dim)
    rewritten = rewrite_asked(turns, asked.drop("given_context"), contexts, system_text)
    reply = asked.select(
        "conv_id",
        (F.col("last_turn") + 2).alias("turn"),
        F.lit("assistant").alias("role"),
        F.col("completion").alias("text"),
    )
    return FollowUp(
        rewritten.unionByName(reply),
        outcomes.select("conv_id", "status", "reason", "error", "input_moderated", "output_moderated"),
    )


def follow_up_nested(
    conversations: DataFrame,
    points: DataFrame,
    *,
    embedder: Embedder,
    dim: int,
    system_text: str,
    completions: DataFrame | Completer,
    input_verdicts: DataFrame | Moderator | None = None,
    output_verdicts: DataFrame | Moderator | None = None,
) -> DataFrame:
    """Follow-up over payloads ``conv_id, conversation``: one row in, one row out.

    Optional columns: ``given_context`` (where it is not null, nothing is retrieved),
    ``model`` and ``max_length``, which a completer function gets; 0 is rejected. A conversation is one row, so its rewriting is row-local; only the questions'
    contexts, completions and verdicts are joined. Of completions in a table the outcome is known first, and
    contexts are found for the answered conversations only.
    """
    optional = [c for c in ("given_context", "model", "max_length") if c in conversations.columns]
    read = conversations.select(
        "conv_id", nested_known_roles(F.col("conversation")).alias("conversation"), *optional
    )
    if "given_context" not in optional:
        read = read.withColumn("given_context", F.lit(None).cast("string"))
    located = read.withColumn("last_user", nested_last_user(F.col("conversation")))
    said = located.withColumn("question", F.get("conversation", "last_user"))
    unread = F.when(F.col("conversation").isNull(), F.lit("malformed_request"))
    checked = _check(with_outcome(said, unread), F.col("question.message"), input_verdicts)
    if input_verdicts is not None and not isinstance(input_verdicts, DataFrame):
        use_checkpoints(conversations.sparkSession)
        checked = checked.checkpoint()
    rewritten = nested_rewrite(
        F.col("conversation"), F.col("last_user"), F.coalesce("context", F.lit("")), system_text
    )

    def with_messages(rows: DataFrame) -> DataFrame:
        contexts = _contexts(rows.where("status = 'ok'"), F.col("question.message"), points, embedder, dim)
        return rows.join(contexts, "conv_id", "left").withColumn("messages", rewritten)

    if isinstance(completions, DataFrame):
        # Every outcome is known before anything is retrieved: nothing is, for what is rejected.
        gated = gate(
            attach_completions(checked, completions, "conv_id"), output_verdicts, "conv_id", "completion", "output"
        )
        if output_verdicts is not None and not isinstance(output_verdicts, DataFrame):
            use_checkpoints(conversations.sparkSession)
            gated = gated.checkpoint()
        gated = with_messages(gated)
    else:
        # The layout a completer function gets is the one of single questions.
        sent = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["message"].alias("text")))
        answered = attach_completions(with_messages(checked), completions, "conv_id", sent)
        gated = gate(answered, output_verdicts, "conv_id", "completion", "output")
    full = F.concat("messages", F.array(message("assistant", F.col("completion"))))
    return gated.select(
        "conv_id",
        "status",
        "reason",
        "error",
        F.when(F.col("status") == "ok", full).alias("conversation"),
    )


def to_chat_responses(answered: DataFrame, version: str) -> DataFrame:
    """Response rows of :func:`follow_up_nested`; both token counts stay null."""
    return answered.select(
        "conv_id",
        "status",
        "reason",
        "error",
        "conversation",
        F.when(F.col("status") == "ok", F.lit(version)).alias("version"),
        F.lit(None).cast("string").alias("question_tokens"),
        F.lit(None).cast("string").alias("response_tokens"),
    )


def _check(rows: DataFrame, question: Column, verdicts: DataFrame | Moderator | None) -> DataFrame:
    reason = F.when(F.col("question").isNull(), F.lit("no_user_turn")).otherwise(check_prompt(question))
    if "max_length" in rows.columns:
        reason = F.coalesce(reason, check_limit(F.col("max_length")))
    checked = with_outcome(rows.withColumn("asked_text", question), reason)
    return gate(checked, verdicts, "conv_id", "asked_text", "input")


def _contexts(asked: DataFrame, question: Column, points: DataFrame, embedder: Embedder, dim: int):
    """``conv_id, context``: the given one, or the default number of points for the last question."""
    given = asked.where("given_context is not null").select("conv_id", F.col("given_context").alias("context"))
    questions = asked.where("given_context is null").select(
        F.col("conv_id").alias("question_id"),
        embedding(question, embedder, dim).alias("embedding"),
        F.lit(DEFAULT_K).alias("k"),
    )
    found = build_context(retrieve(points, questions)).withColumnRenamed("question_id", "conv_id")
    return found.unionByName(given)


def _with_given(rows: DataFrame, contexts: DataFrame | None) -> DataFrame:
    if contexts is None:
        return rows.withColumn("given_context", F.lit(None).cast("string"))
    # One context for a conversation, however often its key is there.
    one = contexts.groupBy("conv_id").agg(F.max("context").alias("given_context"))
    return rows.join(one, "conv_id", "left")


def _with_limits(rows: DataFrame, limits: DataFrame | None) -> DataFrame:
    if limits is None:
        return rows
    # The least limit of a conversation, however often its key is there.
    told = [F.min("max_length").cast("int").alias("max_length")]
    if "model" in limits.columns:
        told.append(F.max("model").alias("model"))
    return rows.join(limits.groupBy("conv_id").agg(*told), "conv_id", "left")
