"""Job log: current state, progress and what is left of interrupted work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.numbering import numbered

STATUSES = ("queued", "running", "paused", "interrupted", "completed", "failed", "canceled")


def list_jobs(jobs: DataFrame, *, seq: str = "append_seq", tasks: int | None = None) -> DataFrame:
    """Jobs newest first, with their ``place`` from 1; the list is dealt to tasks by ranges."""
    return numbered(jobs.withColumn("_newest", -F.col(seq)), [], ["_newest"], "place", tasks=tasks).drop("_newest").orderBy("place")


def job_progress(events: DataFrame, *, job: str = "job_id", seq: str = "append_seq", phase: str = "phase", current: str = "current", cue: str = "cue_id") -> DataFrame:
    """Latest checkpoint of each job and how many cues it has completed."""
    last = F.max_by(F.struct(phase, current), seq)
    done = F.countDistinct(F.when(F.col(phase) == "completed", F.col(cue)))
    return events.groupBy(job).agg(last.alias("last"), done.alias("completed")).select(job, F.col(f"last.{phase}").alias("phase"), F.col(f"last.{current}").alias("current"), "completed")


def recover_interrupted(jobs: DataFrame, *, status: str = "status") -> DataFrame:
    """Jobs that ran or were paused when the log ended are interrupted; ``changed`` marks them."""
    hit = F.col(status).isin("running", "paused")
    return jobs.withColumns({"changed": F.coalesce(hit, F.lit(False)), status: F.when(hit, "interrupted").otherwise(F.col(status))})


def remaining_work(requested: DataFrame, completed: DataFrame, *, job: str = "job_id", cue: str = "cue_id") -> DataFrame:
    """Requested cues of each job that it hasn't completed."""
    return requested.select(job, cue).distinct().join(completed.select(job, cue), [job, cue], "left_anti")


def resumable(jobs: DataFrame, kind: str) -> DataFrame:
    """Jobs of a kind that may be resumed."""
    return jobs.where((F.col("kind") == kind) & F.col("status").isin("interrupted", "failed"))


def job_state(events: DataFrame, *, job: str = "job_id", seq: str = "append_seq", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(last status of each job, events with a status outside the closed set)."""
    known = F.col(status).isin(*STATUSES)
    state = events.where(known).groupBy(job).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias(seq))
    return state, events.where(~F.coalesce(known, F.lit(False)))
