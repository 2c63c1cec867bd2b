"""Moderation gates for questions and answers."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators.checks import with_outcome
from pagelore.session import bound_batches

Moderator = Callable[[pd.Series], Iterable[bool]]


def gate(
    rows: DataFrame, verdicts: DataFrame | Moderator | None, key: str, text: str, stage: str = "input"
) -> DataFrame:
    """Reject flagged rows (``flagged_input`` or ``flagged_output``).

    ``verdicts`` is a table ``key, flagged``, a function over batches of texts, or
    None for no moderation at all. ``{stage}_moderated`` tells whether a row had a
    verdict; a row without one passes.
    """
    if verdicts is None:
        warnings.warn("no moderation: texts pass unchecked", stacklevel=2)
        judged = rows.withColumn("_flagged", F.lit(None).cast("boolean"))
    elif isinstance(verdicts, DataFrame):
        # Combined before the shuffle, so several verdicts on one text stay one row.
        per_key = verdicts.groupBy(key).agg(F.bool_or("flagged").alias("_flagged"))
        judged = rows.join(per_key, key, "left")
    else:
        asked = F.when(F.col("status") == "ok", F.col(text))
        judged = rows.withColumn("_flagged", flagged(asked, verdicts))
    ok = F.col("status") == "ok"
    gated = judged.withColumn(f"{stage}_moderated", ok & F.col("_flagged").isNotNull())
    return with_outcome(gated, F.when(F.col("_flagged"), F.lit(f"flagged_{stage}"))).drop("_flagged")


def flagged(text: Column, moderator: Moderator) -> Column:
    """Verdict column from a function over batches; null texts are not sent."""

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        present = texts[texts.notna()]
        found = [bool(v) for v in moderator(present)] if len(present) else []
        if len(found) != len(present):
            raise ValueError(f"{len(present)} texts gave {len(found)} verdicts")
        filled = iter(found)
        return pd.Series([next(filled) if known else None for known in texts.notna()], dtype="boolean")

    bound_batches(SparkSession.active())
    # Called once per row, whatever the optimizer moves around it.
    return verdict.asNondeterministic()(text)
