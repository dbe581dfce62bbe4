"""Cue search and the rows of the cue list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import trim_unicode


def search_cues(cues: DataFrame, query: str, *, index: str = "cue_index", text: str = "text") -> DataFrame:
    """Cues whose six-digit index or text holds the query; white space around it and case don't count, an empty one lets all pass."""
    q = query.strip().lower()
    if not q:
        return cues
    padded = F.format_string("%06d", F.col(index).cast("bigint"))
    return cues.where(padded.contains(q) | F.coalesce(F.lower(text).contains(q), F.lit(False)))


def cue_list_rows(cues: DataFrame, *, index: str = "cue_index", start: str = "start_ms", text: str = "text", review: str = "review_status", ocr: str = "ocr_status") -> DataFrame:
    shown = F.when(F.col(review) == "approved", "approved").when(F.col(ocr) == "succeeded", "recognised").otherwise("pending_failed")
    return cues.select(index, start, trim_unicode(text).alias(text), shown.alias("display"))
