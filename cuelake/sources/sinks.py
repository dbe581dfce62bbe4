"""Sinks: subtitle text, nested documents, survey reports and log sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.diagnostics import export_session
from cuelake.sources.named_texts import write_named


def write_srt(entries: DataFrame, path: str, *, track: str = "track_id") -> None:
    """One text file a track from (track, seq, entry); rows of a track are in one task, sorted."""
    rows = entries.repartition(track).sortWithinPartitions(track, "seq")
    rows.select(F.col(track), F.col("entry").alias("value")).write.partitionBy(track).option("lineSep", "\n").text(path)


def write_canonical_json(documents: DataFrame, path: str, *, track: str = "track_id") -> None:
    """One JSON document a track from (track, document)."""
    documents.repartition(track).select(F.col(track), F.col("document").alias("value")).write.partitionBy(track).text(path)


def write_documents(lines: DataFrame, path: str, *, owner: str = "track_id", suffix: str = ".json") -> None:
    """One file for each owner from pieces (owner, place, value), named after it, however many pieces it has."""
    write_named(lines.withColumn("_file", F.concat(F.col(owner).cast("string"), F.lit(suffix))), path, name="_file")


def write_survey(report: DataFrame, path: str) -> None:
    report.write.json(path)


def write_session(log: DataFrame, session_id, path: str, *, session: str = "session_id") -> None:
    export_session(log, session_id, session=session).write.text(path)


def append_evidence(rows: DataFrame, path: str, *, partition: str = "project_id") -> None:
    """New rows of an append-only table."""
    rows.write.mode("append").partitionBy(partition).parquet(path)
