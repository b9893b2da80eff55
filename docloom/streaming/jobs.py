"""Job state, running averages and event counts over streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.ordering import CANCELABLE, JOB_STATUS, TERMINAL, latest_status
from docloom.operators.stats import ewma
from docloom.streaming.tiers import TieredTable

TRANSITIONS = "job_id string, us long, event string, status string, accepted boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def job_status_stream(events: DataFrame) -> DataFrame:
    """Status per job from its events so far; the batch aggregate as it is, in update mode."""
    return latest_status(events, ["ts", "event"])


class JobWalk(StatefulProcessor):
    """The walk of many jobs, those of one slice, through their states, by event-time timers.

    Events wait in one list until the watermark has passed them, so those that come late or in other batches take their place in
    time; one timer, at the earliest, wakes the slice, which then walks all that is due.  So what a batch costs beside its events is
    counted by slices and not by jobs.  A job's word of state is kept for ``memory`` after its last event, ended or not, so that an event
    of an ended job is known to be illegal; an event that comes later begins a new job.  Timers on a grid of a part of ``memory``
    look for jobs that may leave the store.
    """

    def __init__(self, memory: timedelta):
        self.memory = int(memory.total_seconds() * 1000)
        self.grid = max(1, self.memory // 24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "job string, us long, event string")
        self.jobs = handle.getMapState("jobs", "job string", "status string, last long")

    def _wake(self, us: int, now: int) -> None:
        """A timer just behind the earliest waiting event, unless an earlier one is to come; later ones off the grid go."""
        at, timers = us // 1000 + 1, [timer for timer in self.handle.listTimers() if timer > now]
        for timer in timers:
            if timer > at and timer % self.grid:
                self.handle.deleteTimer(timer)
        if all(timer > at for timer in timers):
            self.handle.registerTimer(at)

    def _look(self, last: int) -> None:
        """A timer on the grid, when a job of that last event may leave."""
        self.handle.registerTimer(((last + self.memory) // self.grid + 1) * self.grid)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            columns = (frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("job_id", "us", "event"))
            added = [(job, int(us), event) for job, us, event in zip(*columns, strict=True) if us is not None]
            if added:
                self.waiting.appendList(added)
                least = min(us for _, us, _ in added)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[str | None, list[tuple[int, str | None]]] = {}
        rest = []
        for job, us, event in self.waiting.get():
            if us < now * 1000:
                due.setdefault(job, []).append((us, event))
            else:
                rest.append((job, us, event))
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        if rest:
            self._wake(min(us for _, us, _ in rest), now)
        rows = []
        for job, events in due.items():
            known = self.jobs.getValue((job,))
            status, last = known or ("pending", None)
            for us, event in sorted(events, key=lambda e: (e[0], e[1] is not None, e[1] or "")):
                if last is not None and us // 1000 > last + self.memory:
                    status = "pending"
                legal = event in JOB_STATUS and status not in TERMINAL
                if event == "canceled":
                    legal = status in CANCELABLE
                status, last = JOB_STATUS[event] if legal else status, us // 1000
                rows.append((job, us, event, status, legal))
            if last + self.memory >= now:
                self.jobs.updateValue((job,), (status, last))
                if known is None:
                    self._look(last)
            elif known is not None:
                self.jobs.removeKey((job,))
        if expiredTimerInfo.getExpiryTimeInMs() % self.grid == 0:
            self._forget(now)
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "us", "event", "status", "accepted"])

    def _forget(self, now: int) -> None:
        """Jobs whose time is over leave the store; what is due has been walked by then."""
        held = [(job, last) for job, (_, last) in self.jobs.iterator()]
        for job, last in held:
            if last + self.memory < now:
                self.jobs.removeKey(job)
        left = [last for _, last in held if last + self.memory >= now]
        if left:
            self._look(min(left))

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, lateness: str = "1 hour", memory: timedelta = timedelta(days=1), slices: int = 4096) -> DataFrame:
    """Every event with the status after it and whether it was allowed, in time order (ties: by name).

    A row comes out once the watermark has passed its event; events that are later than ``lateness`` are dropped.  Jobs are dealt to
    ``slices`` by a hash; the events of a slice that come due together are held by one task.  The state store must be RocksDB's, which this
    sets where the session names another.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    ts = F.col("ts").cast("timestamp")
    rows = events.select("job_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "event").withWatermark("ts", lateness)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("job_id"), F.lit(slices)))
    walked = rows.groupBy("slice").transformWithStateInPandas(JobWalk(memory), TRANSITIONS, "append", "EventTime")
    return walked.select("job_id", F.timestamp_micros("us").alias("ts"), "event", "status", "accepted")


class RunningAverage(TieredTable):
    """Running benchmark per operation over micro-batches: (operation, hundredths, runs).

    A batch's rows are cut into ranges and blocks over all tasks, as in ``ewma``, and carried on from the average before it; so
    one hot operation is as parallel as many.  Rows are ordered by ``ts`` and what follows in ``order`` within a batch.
    """

    def __init__(self, folder: str, order: tuple[str, ...] = ("ts",), value: str = "duration_ms", **layout):
        super().__init__(folder, ("operation",), **layout)
        self.order, self.value = list(order), value

    def write(self, batch: DataFrame, batch_id: int) -> None:
        known = self.lookup(batch.select("operation"), before=batch_id)
        rows = ewma(batch, ["operation"], self.order, self.value, start=known)
        super().write(rows.select("operation", F.round(F.col("ewma") * 100).cast("long").alias("hundredths"), "runs"), batch_id)

    __call__ = write

    def averages(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).select("operation", "runs", (F.col("hundredths") / 100).alias("ewma"))


def event_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", width: str = "1 day",
                 lateness: str = "1 hour") -> DataFrame:
    """Events per kind and window; late events count until the watermark has passed."""
    return (
        events.withWatermark(ts, lateness).groupBy(F.window(ts, width), kind)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), kind, "events")
    )


def without_repeats(events: DataFrame, key: str = "event_id", ts: str = "ts",
                    lateness: str = "1 hour") -> DataFrame:
    """Drop events whose id was seen within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
