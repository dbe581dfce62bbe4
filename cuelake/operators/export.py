"""Derived exports: which cues go out, as what text, and what the format cannot carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators.evidence import effective_revision
from cuelake.operators.numbering import numbered

#: Codes in their order, and what the message says of each.
LOSSES = (
    ("multiple_blocks_flattened", "holds several text blocks; portable SRT output joins them into one run of lines"),
    ("vertical_writing_lost", "holds vertical text; portable SRT output writes it as horizontal lines"),
    ("block_position_lost", "places its blocks differently; portable SRT output keeps no position at all"),
    ("ruby_flattened", "contains ruby annotations; SRT keeps only the base text"),
    ("text_color_omitted", "contains text colors; portable SRT output omits them"),
    ("baseline_styles_omitted", "contains strikethrough or baseline styles; portable SRT output omits them"),
)


def select_track(tracks: DataFrame, cues: DataFrame, requested: DataFrame | None = None, *, project: str = "project_id", track: str = "track_id") -> DataFrame:
    """(project, track, error): the requested track, else the only one that has cues."""
    if requested is not None:
        known = tracks.select(project, track, F.lit(True).alias("_known"))
        return requested.join(known, [project, track], "left").select(project, track, F.when(F.col("_known").isNull(), "track not found").alias("error"))
    having = tracks.join(cues.select(track).distinct(), track, "left_semi").groupBy(project).agg(F.count("*").alias("n"), F.min(track).alias(track))
    every = tracks.select(project).distinct().join(having, project, "left")
    error = F.when(F.col("n").isNull(), "no track has cues").when(F.col("n") > 1, "a track must be named")
    return every.select(project, F.when(error.isNull(), F.col(track)).alias(track), error.alias("error"))


def export_cues(cues: DataFrame, revisions: DataFrame, scope: str = "all", *, cue: str = "cue_id", seq: str = "append_seq", track: str = "track_id", status: str = "review_status") -> DataFrame:
    """Cues with their effective revision; times are the revision's. ``scope`` is all or approved."""
    rows = cues if scope == "all" else cues.where(F.col(status) == "approved")
    now = effective_revision(revisions, cue=cue, seq=seq).drop(seq)
    keep = [c for c in rows.columns if c == cue or c not in now.columns]
    return rows.select(*keep).join(now, cue)


def skipped_cues(cues: DataFrame, exported: DataFrame, *, cue: str = "cue_id", track: str = "track_id") -> DataFrame:
    out = exported.select(F.col(cue).alias("_out")).distinct()
    return cues.join(out, F.col(cue) == F.col("_out"), "left").groupBy(track).agg((F.count("*") - F.count("_out")).alias("skipped"))


def render_srt(cues: DataFrame, *, track: str = "track_id", start: str = "start_ms", end: str = "end_ms", index: str = "cue_index", blocks: str = "blocks") -> DataFrame:
    """(track, seq, entry): one SRT entry per cue, numbered by place after sorting and not by cue index."""
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(b["lines"], X.srt_line)))
    return render_text(cues.withColumn("_text", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).withColumn("_text", F.array_join("_text", "")), "_text", track=track, start=start, end=end, index=index)


def render_text(cues: DataFrame, text: str, *, track: str, start: str, end: str, index: str, tasks: int | None = None) -> DataFrame:
    """``render_srt`` of lines that are rendered already, each with its line break; a track of any size is spread over tasks."""
    entry = F.concat(F.col("seq").cast("string"), F.lit("\n"), X.srt_timestamp(start), F.lit(" --> "), X.srt_timestamp(end), F.lit("\n"), F.col(text), F.lit("\n"))
    narrow = cues.select(*dict.fromkeys((track, index, start, end, text)))
    return numbered(narrow, [track], [start, end, index], "seq", tasks=tasks).select(track, index, "seq", entry.alias("entry"))


def cue_losses(blocks: Column) -> Column:
    """Codes of what SRT cannot carry of a document, each once, in the order of the table."""
    spans = F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(b["lines"], lambda x: x.spans))))
    first = F.try_element_at(blocks, F.lit(1)).position
    found = {
        "multiple_blocks_flattened": F.size(blocks) > 1,
        "vertical_writing_lost": F.exists(blocks, lambda b: b.writing_mode.startswith("vertical")),
        "block_position_lost": F.exists(blocks, lambda b: ~b.position.eqNullSafe(first)),
        "ruby_flattened": F.exists(spans, lambda s: s.type == "ruby"),
        "text_color_omitted": F.exists(spans, lambda s: s.color.isNotNull()),
        "baseline_styles_omitted": F.exists(spans, lambda s: F.arrays_overlap(s.styles, F.array(F.lit("strikethrough"), F.lit("superscript"), F.lit("subscript")))),
    }
    return F.filter(F.array(*[F.when(found[c], F.lit(c)) for c, _ in LOSSES]), lambda c: c.isNotNull())


def export_warnings(cues: DataFrame, *, cue: str = "cue_id", index: str = "cue_index", blocks: str = "blocks", track: str | None = None) -> DataFrame:
    """(cue, index, place, code, message): a row for each kind of loss of each cue."""
    said = F.create_map(*[F.lit(x) for pair in LOSSES for x in pair])
    keys = [cue, index] + ([track] if track else [])
    rows = cues.select(*keys, F.posexplode(cue_losses(F.col(blocks))).alias("place", "code"))
    return rows.withColumn("message", F.concat(F.lit("Cue "), F.col(index).cast("string"), F.lit(" "), F.element_at(said, F.col("code"))))


def warning_summary(warnings: DataFrame, *, track: str = "track_id", code: str = "code") -> DataFrame:
    return warnings.groupBy(track, code).agg(F.count("*").alias("cues"))


def canonical_documents(cues: DataFrame, *, track: str = "track_id", columns: tuple[str, ...] = ("start_ms", "end_ms", "cue_index"), more: tuple[str, ...] = ()) -> DataFrame:
    """One nested document a track: format marker, version and cues by start, end and index."""
    listed = F.array_sort(F.collect_list(F.struct(*columns, *more)))
    return cues.groupBy(track).agg(listed.alias("cues")).select(track, F.to_json(F.struct(F.lit("subtitle-evidence").alias("format"), F.lit(2).alias("version"), F.col(track), F.col("cues"))).alias("document"))


def document_lines(owners: DataFrame, lists: dict[str, DataFrame], *, owner: str, order: dict[str, tuple[str, ...]], head: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """(owner, place, value): the JSON document of each owner in pieces, for documents that are larger than a row should be.

    ``owners`` has a row for each owner, whose columns ``head`` begin the document; ``lists`` has
    the rows of each array by name and ``order`` their columns, which they are sorted by. A document
    is its pieces by ``place``, one after the other: what ``to_json`` of it all as one row would
    give. No array is collected; an owner of any size is spread over tasks.
    """
    whole = F.to_json(F.struct(*(head or (owner,))))
    begun, first = whole.substr(F.lit(1), F.length(whole) - 1), True
    parts = []
    for n, (name, rows) in enumerate(lists.items()):
        opens = F.concat(begun if first else F.lit("]"), F.when(F.lit(not first) | (F.length(begun) > 1), ",").otherwise(""), F.lit(f'"{name}":['))
        parts.append(owners.select(F.col(owner), F.lit(n).alias("list"), F.lit(0).cast("bigint").alias("nth"), opens.alias("value")))
        own = rows.join(owners.select(owner), owner, "left_semi").select(owner, *[c for c in order[name] if c != owner])
        counted = numbered(own, [owner], list(order[name]), "_nth", tasks=tasks)
        parts.append(counted.select(F.col(owner), F.lit(n).alias("list"), F.col("_nth").cast("bigint").alias("nth"), F.concat(F.when(F.col("_nth") > 1, ",").otherwise(""), F.to_json(F.struct(*order[name]))).alias("value")))
        first = False
    parts.append(owners.select(F.col(owner), F.lit(len(lists)).alias("list"), F.lit(0).cast("bigint").alias("nth"), F.lit("]}").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(owner, F.struct("list", "nth").alias("place"), "value")


def canonical_lines(cues: DataFrame, *, track: str = "track_id", columns: tuple[str, ...] = ("start_ms", "end_ms", "cue_index"), more: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """``canonical_documents`` in pieces: the same bytes for a track of any number of cues."""
    owners = cues.select(track).distinct().withColumns({"format": F.lit("subtitle-evidence"), "version": F.lit(2)})
    return document_lines(owners, {"cues": cues}, owner=track, order={"cues": (*columns, *more)}, head=("format", "version", track), tasks=tasks)


def export_audit(artifacts: DataFrame, *, project: str = "project_id") -> DataFrame:
    """Audit rows of artifacts that were written."""
    return artifacts.where("written").select(project, F.expr("uuid()").alias("id"), "format", "path", "settings", F.current_timestamp().alias("created_at"))
