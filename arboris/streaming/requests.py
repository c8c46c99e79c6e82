"""Streams: comparison requests in micro-batches, and reviewers' decisions without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arboris.plans.jobs import Batch, compare
from arboris.plans.localization import Policy


def compare_stream(requests: DataFrame, locale: str, sink: Callable[[Batch, int], None], checkpoint: str, policy: Policy | None = None, **trigger) -> StreamingQuery:
    """Compare each micro-batch of a stream of requests; ``sink`` gets the batch and its number, which is the same if it comes again."""

    def one(batch: DataFrame, number: int) -> None:
        sink(compare(batch, locale, policy), number)

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()


def decisions_once(decisions: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of decisions with each decision_id once; ids are remembered for ``delay`` of event time."""
    return decisions.withWatermark("decided_at", delay).dropDuplicatesWithinWatermark(["decision_id"])
