"""Job feeds with state of their own: cues that are done, and jobs that fall silent.

Both keep their state in RocksDB (``spark.sql.streaming.stateStore.providerClass``), can begin from
the batch log, and go on from there as one long run would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("completed", "failed", "canceled")


def use_rocksdb(spark: SparkSession) -> None:
    """Let queries that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Progress(StatefulProcessor):
    def __init__(self, done_phase: str, idle_ms: int | None):
        self.done_phase, self.idle_ms = done_phase, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "cue_id string", "seen boolean", self.idle_ms)
        self.last = handle.getValueState("last", "seq long, phase string, current int, completed long", self.idle_ms)

    def new(self, done: set[str], completed: int) -> list[str]:
        """Cues that the state does not have yet; each question to it is a call to another process, so a state no larger than the set is read at once."""
        if completed == 0 or not done:
            return list(done)
        if completed <= len(done):
            return list(done - {k[0] for k in self.done.keys()})
        return [c for c in done if not self.done.containsKey((c,))]

    def fold(self, frames: Iterator[pd.DataFrame]) -> tuple:
        seq, phase, current, completed = self.last.get() if self.last.exists() else (None, None, None, 0)
        for frame in frames:
            done = {c for p, c in zip(frame["phase"], frame["cue_id"], strict=True) if p == self.done_phase and c is not None}
            for cue in self.new(done, completed):
                self.done.updateValue((cue,), (True,))
                completed += 1
            for s, p, c in zip(frame["append_seq"], frame["phase"], frame["current"], strict=True):
                if seq is None or s > seq:
                    seq, phase, current = int(s), p, None if pd.isna(c) else int(c)
        self.last.update((seq, phase, current, completed))
        return phase, current, completed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        phase, current, completed = self.fold(rows)
        yield pd.DataFrame({"job_id": [key[0]], "phase": [phase], "current": pd.array([current], "Int32"), "completed": [completed]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.fold(iter([initialState]))

    def close(self) -> None:
        pass


EVENTS = ("job_id", "append_seq", "phase", "current", "cue_id")


def stream_job_progress(events: DataFrame, *, log: DataFrame | None = None, done_phase: str = "completed", idle: int | None = None) -> DataFrame:
    """(job_id, phase, current, completed): the newest phase of each job and how many of its cues are done; for update mode.

    Events have (job_id, append_seq, phase, current, cue_id). A cue counts once, however often it is
    reported, so that the state has a job's newest event and an entry for each cue that is done.
    ``log`` is the batch log up to where the stream begins. State of a job goes after ``idle``
    milliseconds without an event (None: never); what comes later begins anew.
    """
    cast = lambda df: df.select(F.col("job_id").cast("string").alias("job_id"), F.col("append_seq").cast("long").alias("append_seq"), "phase", F.col("current").cast("int").alias("current"), F.col("cue_id").cast("string").alias("cue_id"))
    before = None
    if log is not None:  # of what is done one event a cue, of the rest the newest
        rows = cast(log)
        done = rows.where(F.col("phase") == done_phase).groupBy("job_id", "phase", "cue_id").agg(F.max_by(F.struct("append_seq", "current"), "append_seq").alias("e")).select("job_id", "e.append_seq", "phase", "e.current", "cue_id")
        last = rows.groupBy("job_id").agg(F.max_by(F.struct(*EVENTS[1:]), "append_seq").alias("e")).select("job_id", "e.*")
        before = done.unionByName(last).groupBy("job_id")
    mode = "ProcessingTime" if idle else "None"
    return cast(events).groupBy("job_id").transformWithStateInPandas(_Progress(done_phase, idle), "job_id string, phase string, current int, completed long", "Update", mode, before)


class _Stale(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, status string, timer long")

    def fold(self, frames: Iterator[pd.DataFrame], timers) -> None:
        at, status, timer = self.last.get() if self.last.exists() else (None, None, None)
        for frame in frames:
            for when, s in zip(frame["at"].astype("datetime64[ms]").astype("int64"), frame["status"], strict=True):
                if at is None or when >= at:
                    at, status = int(when), s
        if timer is not None:
            self.handle.deleteTimer(timer)
        if status in ENDED:
            self.last.clear()
            return
        timer = max(at + self.timeout_ms, timers.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.last.update((at, status, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.fold(rows, timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "status": ["interrupted"], "last_at": [pd.Timestamp(at, unit="ms")]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.fold(iter([initialState]), timerValues)

    def close(self) -> None:
        pass


def stream_stale_jobs(events: DataFrame, timeout_seconds: int, *, job: str = "job_id", at: str = "at", delay: str = "0 seconds", log: DataFrame | None = None) -> DataFrame:
    """(job_id, status, last_at): a running job without an event for ``timeout_seconds`` of event time is interrupted; for append mode.

    Events have (job, status, at). State is one row and one timer a job; it goes when the job ends or
    is reported. ``log`` is the batch log up to where the stream begins: jobs that it leaves running
    are watched from their last event there.
    """
    named = lambda df: df.select(F.col(job).cast("string").alias("job_id"), "status", F.col(at).cast("timestamp").alias("at"))
    before = None
    if log is not None:
        last = named(log).groupBy("job_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "status")).alias("e")).select("job_id", "e.*")
        before = last.where(~F.col("status").isin(*ENDED)).groupBy("job_id")
    rows = named(events).withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(_Stale(timeout_seconds * 1000), "job_id string, status string, last_at timestamp", "Append", "EventTime", before)
