"""Conversations as turn rows (``conv_id, turn, role, text``) and as nested payloads.

``turn`` orders the turns of a conversation and need not be dense. Turn rows of one
conversation are never gathered in one task: only its first and last position and
its last question are aggregated, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.prompts import followup_message

# The roles a conversation may hold.
ROLES = ("system", "assistant", "user")

_TURN = ("conv_id", "turn", "role", "text")


def known_roles(turns: DataFrame) -> DataFrame:
    """Drop turns of any other role."""
    return turns.where(F.col("role").isin(*ROLES))


def explode_turns(conversations: DataFrame) -> DataFrame:
    """Turn rows of ``conv_id, conversation array<struct<role, message>>``.

    A null or empty conversation is one row whose turn, role and text are null.
    """
    rows = conversations.select("conv_id", F.posexplode_outer("conversation").alias("turn", "m"))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", F.col("m.message").alias("text")
    )


def nest_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, conversation`` with the messages in turn order: the payload form.

    Rows without a turn stand for an empty conversation and hold no message.
    """
    turn = F.when(F.col("turn").isNotNull(), F.struct("turn", "role", F.col("text").alias("message")))
    listed = F.array_sort(F.collect_list(turn))
    bare = F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["message"].alias("message")))
    return turns.groupBy("conv_id").agg(bare.alias("conversation"))


def summarise(turns: DataFrame) -> DataFrame:
    """``conv_id, first_turn, last_turn, question struct<turn, text>`` per conversation.

    ``question`` is the last user turn, null if there is none. Turns of other roles than
    the known ones do not count; a conversation of such turns alone has nulls.
    """
    said = F.when(F.col("role") == "user", F.struct("turn", "text"))
    known = F.when(F.col("role").isin(*ROLES), F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.min(known).alias("first_turn"),
        F.max(known).alias("last_turn"),
        F.max_by(said, F.when(F.col("role") == "user", F.col("turn"))).alias("question"),
    )


def last_user_turn(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, text, status``; ``no_user_turn`` where nobody asked anything."""
    return summarise(turns).select(
        "conv_id",
        F.col("question.turn").alias("turn"),
        F.col("question.text").alias("text"),
        F.when(F.col("question").isNull(), "no_user_turn").otherwise("ok").alias("status"),
    )


def rewrite_followup(turns: DataFrame, contexts: DataFrame, system_text: str) -> DataFrame:
    """Turn rows with the system text first and the last question, in context, last.

    ``contexts`` is ``conv_id, context``. The other turns keep their place, so a
    client's own system turn stays. Conversations without a user turn go.
    """
    return rewrite_asked(turns, summarise(turns).where("question is not null"), contexts, system_text)


def rewrite_asked(
    turns: DataFrame, asked: DataFrame, contexts: DataFrame, system_text: str
) -> DataFrame:
    """:func:`rewrite_followup` for the conversations summarised in ``asked``.

    The contexts, by far the widest column, meet only the one row that shows them.
    """
    system = asked.select(
        "conv_id",
        (F.col("first_turn") - 1).alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system_text).alias("text"),
    )
    question_turn = asked.select("conv_id", F.col("question.turn").alias("asked"))
    kept = turns.join(question_turn, "conv_id").where("turn <> asked").select(*_TURN)
    question = followup_message(F.col("question.text"), F.coalesce("context", F.lit("")))
    rewritten = asked.join(contexts, "conv_id", "left").select(
        "conv_id", (F.col("last_turn") + 1).alias("turn"), F.lit("user").alias("role"), question.alias("text")
    )
    return system.unionByName(kept).unionByName(rewritten)


def append_reply(turns: DataFrame, replies: DataFrame) -> DataFrame:
    """Add ``conv_id, completion`` as an assistant turn after the last one."""
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    added = replies.join(ends, "conv_id").select(
        "conv_id", "turn", F.lit("assistant").alias("role"), F.col("completion").alias("text")
    )
    return turns.select(*_TURN).unionByName(added)


# The same steps on one payload: a whole conversation is one row, so none shuffles.


def nested_known_roles(conversation: Column) -> Column:
    return F.filter(conversation, lambda m: m["role"].isin(*ROLES))


def nested_last_user(conversation: Column) -> Column:
    """Index of the last user message; null if there is none."""
    return F.array_max(F.transform(conversation, lambda m, i: F.when(m["role"] == "user", i)))


def nested_rewrite(conversation: Column, last_user: Column, context: Column, system_text: str) -> Column:
    question = F.get(conversation, last_user)["message"]
    others = F.filter(conversation, lambda m, i: i != last_user)
    return F.concat(
        F.array(message("system", F.lit(system_text))),
        others,
        F.array(message("user", followup_message(question, context))),
    )


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("message"))
