"""The life of comparison jobs as a stateful stream: each job passes through its states once and has one outcome.

Jobs report events (job_id, state, code, at) in any order and any number of times, as a batch that runs again after a lost
driver reports them again. :func:`lifecycle` keeps the state of each job and answers with what came of the events.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arboris.plans import report
from arboris.plans.jobs import Batch
from arboris.plans.localization import Policy
from arboris.streaming.requests import compare_stream

#: Where a job may go from each state; those without an entry are outcomes. Fixed values.
NEXT = {"": ("CREATED",), "CREATED": ("VALIDATING_INPUTS",), "VALIDATING_INPUTS": ("REJECTED", "RUNNING"), "RUNNING": ("COMPLETED", "FAILED")}
TIMED_OUT = "JOB_TIMED_OUT"
SCHEMA = "job_id string, n int, from_state string, to_state string, code string, at timestamp, accepted boolean, n_events long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ahead(state: str) -> set[str]:
    """The states that can still follow."""
    step = set(NEXT.get(state, ()))
    return step.union(*map(_ahead, step))


class _Jobs(StatefulProcessor):
    """State of a job: where it is, how it got there, its timer, and at most one event of each state that came too early."""

    def __init__(self, patience_ms: int, memory_ms: int):
        self.patience, self.memory = patience_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, n int, timer long, early string")

    def _rest(self, state: str, n: int, old: int | None, since: int, early: dict) -> None:
        """Keep the state, and wake up when the job's patience, or the memory of its outcome, is over."""
        timer = since + (self.patience if state in NEXT else self.memory)
        if old != timer:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.job.update((state, n, timer, json.dumps(early)))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, n, timer, early = self.job.get() if self.job.exists() else ("", 0, None, "{}")
        waiting = json.loads(early)  # state -> [at, code]
        count: dict[str, int] = {}
        first: dict[str, list] = {}
        for r in rows:  # of each state the first event counts, so that memory doesn't grow with repeats
            count[r["state"]] = count.get(r["state"], 0) + 1
            new = [r["ms"], r["code"] or ""]
            first[r["state"]] = min(first.get(r["state"], new), new)
        for s, new in first.items():
            if s in _ahead(state):
                waiting[s] = min(waiting.get(s, new), new)
        since = min(x[0] for x in (first | waiting).values())
        taken = set()
        while ready := [(*waiting[s], s) for s in NEXT.get(state, ()) if s in waiting]:
            at, code, to = min(ready)
            n, since = n + 1, max(since, at)
            taken.add(to)
            yield self._row(key, n, state, to, code, at, True, count.get(to, 0))
            state = to
            waiting = {s: x for s, x in waiting.items() if s in _ahead(state)}
        for s in sorted(first):
            if s not in taken and s not in waiting:  # repeated, or no longer possible
                yield self._row(key, None, state, s, first[s][1], first[s][0], False, count[s])
        if taken or timer is None:
            self._rest(state, n, timer, since, waiting)
        else:
            self.job.update((state, n, timer, json.dumps(waiting)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, n, timer, _ = self.job.get() if self.job.exists() else ("", 0, None, "")
        due = expiredTimerInfo.getExpiryTimeInMs()
        if timer != due:
            return
        if state in NEXT and state:
            yield self._row(key, n + 1, state, "FAILED", TIMED_OUT, due, True, 0)
            self._rest("FAILED", n + 1, None, due, {})
        else:
            self.job.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, n, old, new, code, ms, accepted, events) -> Row:
        import datetime

        at = datetime.datetime.fromtimestamp(ms / 1000)
        return Row(job_id=key[0], n=n, from_state=old or None, to_state=new, code=code or None, at=at, accepted=accepted, n_events=events)


def lifecycle(events: DataFrame, delay: str = "10 minutes", patience_s: int = 3600, memory_s: int = 7 * 86400) -> DataFrame:
    """What came of a stream of ``events`` (job_id, state, code, at): a row for each state that events of a micro-batch
    name. An accepted row is the job's ``n``-th step; of others, which repeat a state or can't follow any more, only
    their number is kept. An event that comes before its turn waits for it. A job that has begun and takes no step for
    ``patience_s`` of event time fails with JOB_TIMED_OUT; ``memory_s`` after its outcome it is forgotten. Events later
    than ``delay`` behind the newest are late, as for any stream. Events of unknown states, without an id or a time are refused
    by :func:`refused`, not here. State is kept in RocksDB, so it may outgrow the executors' memory (``stateful``).
    """
    known = events.where(~_unfit()).select("job_id", "state", "code", "at", F.unix_millis("at").alias("ms")).withWatermark("at", delay)
    processor = _Jobs(patience_s * 1000, memory_s * 1000)
    return known.groupBy("job_id").transformWithState(processor, SCHEMA, "Append", "EventTime")


def _unfit():
    states = sorted(_ahead(""))
    return F.col("job_id").isNull() | F.col("at").isNull() | ~F.coalesce(F.col("state").isin(*states), F.lit(False))


def refused(events: DataFrame) -> DataFrame:
    """The events that no job's life can take in: of unknown states, without an id or without a time."""
    return events.where(_unfit())


def stateful(steps: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``steps`` as Parquet, each exactly once. The session's state store is set for this query only."""
    conf, name = steps.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return steps.writeStream.option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(name) if old is None else conf.set(name, old)


def events_of(jobs: DataFrame, at) -> DataFrame:
    """The events of finished ``jobs`` (pair_id, state, error_code), at one time: what the machine went through until it ended."""
    before = F.when(F.col("state") == "REJECTED", F.array(F.lit("CREATED"), F.lit("VALIDATING_INPUTS"))).otherwise(F.array(F.lit("CREATED"), F.lit("VALIDATING_INPUTS"), F.lit("RUNNING")))
    rows = jobs.select(F.col("pair_id").alias("job_id"), F.col("state").alias("end"), F.col("error_code").alias("code"), F.explode(F.concat(before, F.array("state"))).alias("state"))
    return rows.select("job_id", "state", F.when(F.col("state") == F.col("end"), F.col("code")).alias("code"), at.cast("timestamp").alias("at"))


def run_jobs(requests: DataFrame, locale: str, saved: str, events: str, checkpoint: str, policy: Policy | None = None, **trigger) -> StreamingQuery:
    """Compare a stream of requests, save each batch's reports in the store at ``saved``, and report its events to the folder ``events``.

    Reports come first, then events; a batch that runs again saves a newer version of the same jobs and reports events that
    ``lifecycle`` knows, so each job still has one outcome and one report.
    """

    def sink(batch: Batch, number: int) -> None:
        for loc in batch.by_profile.values():
            if not loc.result.raw.isEmpty():  # a profile without jobs has nothing to save
                report.save(loc, saved)
        events_of(batch.jobs, F.current_timestamp()).write.mode("append").parquet(events)

    return compare_stream(requests, locale, sink, checkpoint, policy, **trigger)
