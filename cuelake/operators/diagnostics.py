"""Diagnostics log: redaction, filters, retention and correlation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.text import SECRET_KEYS

#: Levels of details that are kept, and numbers of a list that is not yet binary data.
DEPTH, NUMBERS = 12, 256
PLAIN = {int, float, bool, type(None)}


def _walk(value, key: str | None, secrets: tuple[str, ...], depth: int):
    if key is not None and key.lower().replace("-", "_") in SECRET_KEYS:
        return "[REDACTED]"
    if depth > DEPTH:
        return "[TOO DEEP]"
    if isinstance(value, dict):
        return {k: _walk(v, k, secrets, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        kinds = set(map(type, value))
        if len(value) > NUMBERS and kinds <= {int, float}:
            return {"redacted": "binary_data", "byte_length": len(value)}
        if depth < DEPTH and kinds <= PLAIN:  # nothing in it can change
            return value
        return [_walk(v, key, secrets, depth + 1) for v in value]
    if isinstance(value, str):
        if value.startswith("data:") and ";base64," in value:
            return {"redacted": "base64_data", "estimated_byte_length": len(value.split(";base64,", 1)[1].encode()) * 3 // 4}
        for s in secrets:
            value = value.replace(s, "[REDACTED]")
    return value


def redact_details(df: DataFrame, *, details: str = "details", secrets: tuple[str, ...] = ()) -> DataFrame:
    """JSON details with secret keys redacted at any depth, data addresses and long number arrays as markers.

    A key is inherited through arrays. Text that isn't JSON becomes a marker, as nothing is known of it.
    """
    known = tuple(s for s in secrets if s)
    written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return written.encode(_walk(json.loads(t), None, known, 0))
            except ValueError:
                return '"[NOT JSON]"'

        return texts.map(one)

    return df.withColumn(details, clean(F.col(details)))


def filter_log(log: DataFrame, *, level: str | None = None, source: str | None = None, query: str = "", seq: str = "sequence", columns: tuple[str, ...] = ("message", "operation", "category", "details"), level_column: str = "level", source_column: str = "source") -> DataFrame:
    """Entries of a level and source (None: all) that hold ``query`` in one of ``columns``, whatever its case; newest first."""
    rows = log if level is None else log.where(F.col(level_column) == level)
    rows = rows if source is None else rows.where(F.col(source_column) == source)
    if query:
        rows = rows.where(F.lower(F.concat_ws("\n", *columns)).contains(query.lower()))
    return rows.orderBy(F.col(seq).desc())


def log_sources(log: DataFrame, source: str = "source") -> DataFrame:
    return log.select(source).distinct().orderBy(source)


def retain_sessions(log: DataFrame, n: int = 5, *, session: str = "session_id") -> DataFrame:
    """Entries of the newest ``n`` sessions by id; only the list of sessions is ranked."""
    newest = log.select(session).distinct().orderBy(F.col(session).desc()).limit(n)
    return log.join(newest, session, "left_semi")


def tail_entries(log: DataFrame, n: int = 10_000, *, session: str = "session_id", seq: str = "sequence") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.col(seq).desc()))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def correlate(log: DataFrame, *, correlation: str = "correlation_id", seq: str = "sequence", at: str = "created_at_ms", phase: str = "phase") -> DataFrame:
    """First and last time, duration and last phase of each request."""
    return log.where(F.col(correlation).isNotNull()).groupBy(correlation).agg(F.count("*").alias("entries"), F.min(at).alias("started_ms"), (F.max(at) - F.min(at)).alias("duration_ms"), F.max_by(phase, seq).alias("outcome"))


def stage_outcomes(log: DataFrame, phases: list[str], *, keys: tuple[str, ...] = ("operation", "model"), phase: str = "phase") -> DataFrame:
    """Entries by stage, a column for each phase."""
    return log.groupBy(*keys).agg(*[F.count_if(F.col(phase) == p).alias(f"n_{p}") for p in phases])


def export_session(log: DataFrame, session_id, *, session: str = "session_id") -> DataFrame:
    """One session's entries as JSON text."""
    return log.where(F.col(session) == session_id).select(F.to_json(F.struct("*")).alias("value"))
