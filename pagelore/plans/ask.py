"""One-off questions in bulk: check, moderate, retrieve, prompt, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.tokens import SpaceTokenizer
from pagelore.operators.answers import Completer, attach_completions, count_response_tokens
from pagelore.operators.checks import validate
from pagelore.operators.embed import Embedder, embedding
from pagelore.operators.moderate import Moderator, gate
from pagelore.operators.prompts import message_list
from pagelore.operators.retrieve import build_context, retrieve
from pagelore.session import use_checkpoints


def check(requests: DataFrame, verdicts: DataFrame | Moderator | None) -> DataFrame:
    """Requests with their outcome before retrieval."""
    checked = gate(validate(requests), verdicts, "request_id", "prompt", "input")
    if verdicts is not None and not isinstance(verdicts, DataFrame):
        # Several plans read the outcome: a model must not be asked once for each.
        use_checkpoints(requests.sparkSession)
        checked = checked.checkpoint()
    return checked


def prepare(
    requests: DataFrame,
    points: DataFrame,
    embedder: Embedder,
    dim: int,
    verdicts: DataFrame | Moderator | None = None,
    tokenizer: SpaceTokenizer | None = None,
) -> DataFrame:
    """Requests with outcome, ``context`` and ``question_tokens``: all a model needs.

    One retrieval serves the prompt and the response. Where an optional column
    ``given_context`` is not null, it is the context, and nothing is retrieved. Rejected requests stay, with
    null context.
    """
    checked = check(requests, verdicts)
    if "given_context" not in checked.columns:
        checked = checked.withColumn("given_context", F.lit(None).cast("string"))
    questions = checked.where("status = 'ok' and given_context is null").select(
        F.col("request_id").alias("question_id"),
        embedding(F.col("prompt"), embedder, dim).alias("embedding"),
        F.col("max_context_length").alias("k"),
    )
    contexts = build_context(retrieve(points, questions)).withColumnRenamed("question_id", "request_id")
    ready = checked.join(contexts, "request_id", "left")
    ok = F.col("status") == "ok"
    return ready.withColumns(
        {
            "context": F.when(ok, F.coalesce("given_context", "context", F.lit(""))),
            "question_tokens": F.when(ok, (tokenizer or SpaceTokenizer()).count(F.col("prompt"))),
        }
    ).drop("given_context")


def respond(
    prepared: DataFrame,
    completions: DataFrame | Completer,
    system_text: str,
    verdicts: DataFrame | Moderator | None = None,
    tokenizer: SpaceTokenizer | None = None,
) -> DataFrame:
    """Prepared requests with completion, output moderation and token count."""
    answered = attach_completions(prepared, completions, "request_id", message_list(system_text))
    gated = gate(answered, verdicts, "request_id", "completion", "output")
    return count_response_tokens(gated, tokenizer)


def ask(
    requests: DataFrame,
    points: DataFrame,
    *,
    embedder: Embedder,
    dim: int,
    system_text: str,
    completions: DataFrame | Completer,
    input_verdicts: DataFrame | Moderator | None = None,
    output_verdicts: DataFrame | Moderator | None = None,
    tokenizer: SpaceTokenizer | None = None,
) -> DataFrame:
    """The whole job; one row per request, rejected ones included."""
    prepared = prepare(requests, points, embedder, dim, input_verdicts, tokenizer)
    return respond(prepared, completions, system_text, output_verdicts, tokenizer)
