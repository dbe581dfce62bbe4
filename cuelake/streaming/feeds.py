"""Structured Streaming over evidence feeds: cues, progress, log tails and effective revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelake.operators.diagnostics import redact_details
from cuelake.operators.ingest import extract_cues
from cuelake.sources.readers import read_diagnostics
from cuelake.sources.segments import segments_in_files

FILES = "path string, modificationTime timestamp, length long, content binary"
PROGRESS = "job_id string, append_seq bigint, phase string, current int, total int, cue_id string, at timestamp"


def stream_cues(spark: SparkSession, glob: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], **trigger) -> StreamingQuery:
    """Cues of stream files as they arrive; ``sink`` gets (cues, failed streams, batch number). A file is the unit of arrival, and a long one is read in byte ranges."""

    def each(files: DataFrame, batch: int) -> None:
        cues, failed = extract_cues(segments_in_files(files).where("error is null"))
        sink(cues, failed, batch)

    files = spark.readStream.format("binaryFile").schema(FILES).load(glob).select("path", "length")
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_progress(events: DataFrame, *, job: str = "job_id", seq: str = "append_seq") -> DataFrame:
    """Latest phase and count of each job, in event order; for update or complete mode.

    The state has a row a job for ever, as an event may still come: as many rows as there are jobs.
    ``jobs.stream_job_progress`` counts cues too and can let go of idle jobs.
    """
    last = events.groupBy(job).agg(F.max_by(F.struct("phase", "current"), seq).alias("last"))
    return last.select(job, "last.phase", "last.current")


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PROGRESS).json(folder)


def stream_log_tail(spark: SparkSession, folder: str, secrets: tuple[str, ...] = (), *, pattern: str = "session-*.jsonl") -> DataFrame:
    """Diagnostics entries of a folder of growing segments as they are written, redacted; for append mode."""
    return redact_details(read_diagnostics(spark, folder, stream=True, pattern=pattern), secrets=secrets)


def stream_effective(revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", columns: tuple[str, ...] = ("author",)) -> DataFrame:
    """The effective revision of each cue, kept up to date; for update or complete mode.

    The state has a row a cue for ever (its newest number and ``columns``), as any cue may be revised
    again; keep ``columns`` narrow and join documents afterwards. ``keyed.follow`` keeps whole rows in a
    table instead, without state.
    """
    return revisions.groupBy(cue).agg(F.max_by(F.struct(seq, *columns), seq).alias("r")).select(cue, "r.*")
