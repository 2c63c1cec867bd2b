"""Completions joined or called, and counted."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.tokens import SpaceTokenizer
from pagelore.operators.checks import with_outcome
from pagelore.session import bound_batches

Completer = Callable[[pd.DataFrame], Iterable[str]]


def attach_completions(
    rows: DataFrame, completions: DataFrame | Completer, key: str, messages: Column | None = None
) -> DataFrame:
    """Add ``completion`` to the rows that may go on; one without is rejected.

    ``completions`` is a table ``key, completion`` or a function over batches. A key that
    is in the table twice is rejected, since neither answer can be told to be right. The
    function gets a frame ``messages`` (a JSON array of role, text), ``model`` and
    ``max_length`` and returns one text per row.
    """
    ok = F.col("status") == "ok"
    if isinstance(completions, DataFrame):
        one = completions.groupBy(key).agg(F.max("completion").alias("completion"), F.count("*").alias("n_found"))
        joined = with_outcome(
            rows.join(one, key, "left"), F.when(F.col("n_found") > 1, F.lit("duplicate_completion"))
        )
        answered = joined.withColumn("completion", F.when(ok, F.col("completion"))).drop("n_found")
    else:
        model = F.col("model") if "model" in rows.columns else F.lit(None).cast("string")
        limit = F.col("max_length") if "max_length" in rows.columns else F.lit(None).cast("int")
        answered = rows.withColumn(
            "completion", _called(completions, F.when(ok, F.to_json(messages)), model, limit)
        )
    return with_outcome(answered, F.when(F.col("completion").isNull(), F.lit("no_completion")))


def count_response_tokens(rows: DataFrame, tokenizer: SpaceTokenizer | None = None) -> DataFrame:
    """``response_tokens`` of the completion as it came, before any trimming."""
    counted = (tokenizer or SpaceTokenizer()).count(F.col("completion"))
    return rows.withColumn("response_tokens", counted)


def _called(completer: Completer, messages: Column, model: Column, max_length: Column) -> Column:
    @F.pandas_udf("string")
    def complete(messages: pd.Series, model: pd.Series, max_length: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"messages": messages, "model": model, "max_length": max_length})
        asked = frame[frame["messages"].notna()]
        texts = list(completer(asked)) if len(asked) else []
        if len(texts) != len(asked):
            raise ValueError(f"{len(asked)} requests gave {len(texts)} completions")
        filled = iter(texts)
        return pd.Series([next(filled) if known else None for known in messages.notna()], dtype=object)

    bound_batches(SparkSession.active())
    # Called once per row, whatever the optimizer moves around it.
    return complete.asNondeterministic()(messages, model, max_length)
