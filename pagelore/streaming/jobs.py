"""Questions and conversations as streams against a table of points.

Each micro-batch runs the batch plan inside ``foreachBatch``. No state is kept
between batches: every record is a whole request. A batch writes to a directory
named after its id, so a batch that is run again after a failure replaces its own
output and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelore.plans.ask import ask
from pagelore.plans.followup import follow_up_nested, to_chat_responses
from pagelore.sources.requests import to_responses

# Resolved once per batch, so that a rebuilt table is picked up without a restart.
PointsSource = Callable[[SparkSession], DataFrame]


def stream_ask(
    requests: DataFrame,
    points: PointsSource,
    output: str,
    checkpoint: str,
    version: str = "",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Answer a stream of requests; ``options`` are those of :func:`ask`.

    ``trigger`` is that of ``writeStream``; by default what has arrived is answered
    and the query ends.
    """

    def answer(batch: DataFrame) -> DataFrame:
        started_ms = int(time.time() * 1000)
        answered = ask(batch, points(batch.sparkSession), **options)
        return to_responses(answered, version, started_ms)

    return _run(requests, answer, output, checkpoint, trigger)


def stream_follow_up(
    conversations: DataFrame,
    points: PointsSource,
    output: str,
    checkpoint: str,
    version: str = "",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Answer a stream of conversations; ``options`` are those of :func:`follow_up_nested`."""

    def answer(batch: DataFrame) -> DataFrame:
        return to_chat_responses(follow_up_nested(batch, points(batch.sparkSession), **options), version)

    return _run(conversations, answer, output, checkpoint, trigger)


def _run(
    source: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    trigger: dict | None,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            answer(batch).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
