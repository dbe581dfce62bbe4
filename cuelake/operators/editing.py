"""Structured text: validation of edits and bulk range edits on spans.

Spans are rows (line key, ord, type, text, base, annotations, styles, color); ``text`` of a ruby
span is null and its base counts. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions import text as X

ANNOTATIONS = "array<struct<text:string,position:string>>"
SPAN = f"struct<type:string,text:string,base:string,annotations:{ANNOTATIONS},styles:array<string>,color:string>"


def shown(span: Column | None = None) -> Column:
    """What a span contributes to its line's text."""
    if span is None:
        return F.coalesce(F.when(F.col("type") == "ruby", F.col("base")).otherwise(F.col("text")), F.lit(""))
    return F.coalesce(F.when(span.type == "ruby", span.base).otherwise(span.text), F.lit(""))


def edit_error(start: Column, end: Column, blocks: Column) -> Column:
    """The first rule that an edited document breaks, in document order; null if it may be saved.

    Fixed values: the messages are those that users of the evidence store know and search for.
    """

    def line_error(line: Column, label: Column) -> Column:
        said = lambda what: F.concat(F.lit("subtitle "), label, F.lit(f" {what}"))

        def span_error(s: Column) -> Column:
            incomplete = (F.coalesce(F.length(s.base), F.lit(0)) == 0) | (F.coalesce(F.size(s.annotations), F.lit(0)) < 1) | F.exists(s.annotations, lambda a: F.coalesce(F.length(a.text), F.lit(0)) == 0)
            return (
                F.when(s.color.isNotNull() & ~s.color.rlike("^#[0-9a-fA-F]{6}$"), said("contains an invalid text color"))
                .when(F.size(F.array_distinct(s.styles)) < F.size(s.styles), said("contains duplicate text styles"))
                .when(F.array_contains(s.styles, "superscript") & F.array_contains(s.styles, "subscript"), said("contains conflicting baseline styles"))
                .when((s.type == "ruby") & F.coalesce(incomplete, F.lit(True)), said("contains an incomplete ruby span"))
            )

        composed = F.array_join(F.transform(line.spans, shown), "")
        first = F.try_element_at(F.filter(F.transform(line.spans, span_error), lambda e: e.isNotNull()), F.lit(1))
        return (
            F.when((F.coalesce(F.length(line.text), F.lit(0)) == 0) | line.text.rlike(r"\p{Cc}"), said("is empty or contains control characters"))
            .when(F.coalesce(F.size(line.spans), F.lit(0)) < 1, said("has no text spans"))
            .otherwise(F.coalesce(first, F.when(composed != line.text, said("does not match its structured spans"))))
        )

    def block_errors(b: Column, i: Column) -> Column:
        label = lambda j: F.concat(F.when(F.size(blocks) > 1, F.concat(F.lit("block "), (i + 1).cast("string"), F.lit(" "))).otherwise(F.lit("")), F.lit("line "), (j + 1).cast("string"))
        empty = F.array(F.concat(F.lit("subtitle block "), (i + 1).cast("string"), F.lit(" has no lines")))
        return F.when(F.size(b["lines"]) < 1, empty).otherwise(F.filter(F.transform(b["lines"], lambda x, j: line_error(x, label(j))), lambda e: e.isNotNull()))

    none = F.coalesce(F.size(blocks), F.lit(0)) < 1
    no_line = F.aggregate(blocks, F.lit(0), lambda a, b: a + F.greatest(F.lit(0), F.size(b["lines"]))) == 0
    return (
        F.when(start >= end, F.lit("the cue end time must be later than its start time"))
        .when(none, F.lit("the subtitle must contain at least one text block"))
        .when(no_line, F.lit("the subtitle must contain at least one line"))
        .otherwise(F.try_element_at(F.flatten(F.transform(blocks, block_errors)), F.lit(1)))
    )


def validate_edit(documents: DataFrame, *, start: str = "start_ms", end: str = "end_ms", blocks: str = "blocks") -> DataFrame:
    """``documents`` with ``error``."""
    return documents.withColumn("error", edit_error(F.col(start), F.col(end), F.col(blocks)))


def _span_rows(spans: DataFrame) -> DataFrame:
    """The span columns, with those that a table lacks as nulls."""
    missing = {"type": F.lit("text"), "base": F.lit(None).cast("string"), "annotations": F.lit(None).cast(ANNOTATIONS), "styles": F.array().cast("array<string>"), "color": F.lit(None).cast("string")}
    return spans.withColumns({c: e for c, e in missing.items() if c not in spans.columns})


def coalesce_spans(spans: DataFrame, *, line: str | Sequence[str] = "line", order: str = "ord") -> DataFrame:
    """Canonical spans of each line: empty text spans go, text neighbours of equal styles and colour join, ruby never does.

    Result: (line, ord from 1, type, text, base, annotations, styles, color). Runs are found by a
    change flag and its running sum.
    """
    keys = [line] if isinstance(line, str) else list(line)
    rows = _span_rows(spans).withColumns({"styles": X.canonical_styles(F.col("styles")), "color": X.canonical_colour("color"), "_part": F.lit(None).cast("int")})
    return _runs(rows, keys, order)


def _runs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Canonical spans of rows with canonical looks; ruby rows of one ``_part`` are pieces of one span, a null part is a span of its own."""
    rows = rows.where((F.col("type") == "ruby") | (F.length("text") > 0))
    w = Window.partitionBy(*keys).orderBy(order)
    look = F.struct(F.col("type"), F.concat_ws(",", "styles").alias("styles"), F.coalesce("color", F.lit("")).alias("color"))
    other = (F.col("type") == "ruby") & ~F.coalesce(F.col("_part") == F.lag("_part").over(w), F.lit(False))
    starts = other | ((F.col("type") == "text") & ~look.eqNullSafe(F.lag(look).over(w)))
    rows = rows.withColumn("_starts", starts.cast("int")).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, order).alias(c)
    joined = lambda c, to: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.lit("")).alias("t")))), lambda s: s.t), "").alias(to)
    runs = rows.groupBy(*keys, "_run").agg(first("type"), joined("text", "text"), joined("base", "base"), first("annotations"), first("styles"), first("color"))
    ruby = F.col("type") == "ruby"
    return runs.select(*keys, F.col("_run").cast("bigint").alias("ord"), "type", F.when(~ruby, F.col("text")).alias("text"), F.when(ruby, F.col("base")).alias("base"), "annotations", "styles", "color")


def line_texts(spans: DataFrame, *, line: str = "line", order: str = "ord") -> DataFrame:
    """(line, text): what the spans of each line compose."""
    return spans.groupBy(line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), shown().alias("t")))), lambda s: s.t), "").alias("text"))


def with_offsets(spans: DataFrame, *, line: str = "line", order: str = "ord") -> DataFrame:
    """Spans with ``start`` and ``end`` in their line."""
    rows = _span_rows(spans)
    w = Window.partitionBy(line).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(shown())).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length(shown()))


def span_overlap(spans: DataFrame, selections: DataFrame, *, line: str = "line", order: str = "ord", selection: str = "selection") -> DataFrame:
    """(line, selection, spans, styles, coloured) for each selection (line, selection, sel_start, sel_end) that hits a span.

    An interval join keyed by line: spans with sel_start < end and sel_end > start. ``styles`` are
    those that all hit spans have, in canonical order.
    """
    hit = _hits(spans, selections, line=line, order=order)
    counts = [F.count_if(F.array_contains("styles", s)).alias(f"_{s}") for s in X.STYLES]
    rows = hit.groupBy(line, selection).agg(F.count("*").alias("spans"), F.bool_or(X.canonical_colour("color").isNotNull()).alias("coloured"), F.count_distinct(F.coalesce(X.canonical_colour("color"), F.lit(""))).alias("_colours"), F.min(X.canonical_colour("color")).alias("_colour"), *counts)
    common = F.filter(F.array(*[F.when(F.col(f"_{s}") == F.col("spans"), F.lit(s)) for s in X.STYLES]), lambda s: s.isNotNull())
    return rows.select(line, selection, "spans", common.alias("styles"), "coloured", F.when(F.col("_colours") == 1, F.col("_colour")).alias("colour"))


def _hits(spans: DataFrame, selections: DataFrame, *, line: str, order: str) -> DataFrame:
    placed = with_offsets(spans, line=line, order=order)
    return placed.join(selections, line).where("sel_start < end and sel_end > start")


#: Columns of an edit; ``kind`` is style, color, annotate or remove, and says which of the last four count.
EDIT = {"end_line": None, "sel_start": "bigint", "sel_end": "bigint", "kind": "string", "style": "string", "color_value": "string", "annotation": "string", "position": "string"}


def edit_lines(spans: DataFrame, edits: DataFrame, *, line: str = "line", order: str = "ord", nth: str | None = "nth") -> tuple[DataFrame, DataFrame]:
    """(canonical spans of all lines after the edits, refused edits with a reason); any number of edits a line, in the order of ``nth``.

    Edits don't change what a line says, so offsets hold throughout. Each line's spans are cut once
    at every border of a span or an edit, and the edits are folded over the pieces:

    * style: taken from the pieces if all that are hit have it, else given to them; superscript and
      subscript exclude each other
    * color: ``color_value`` for the pieces, null for none
    * annotate: one ruby span with the styles that all hit pieces share and their colour if they
      have one. Refused if it goes over several lines, is empty, names no line, or cuts a ruby span
    * remove: a ruby span of just that range becomes text

    A ruby span that is hit in part is restyled whole. A range that hits nothing changes nothing;
    empty text spans go first. Spans and edits of a line meet in one row: a line is one of a subtitle.
    """
    place = F.col(nth) if nth else F.lit(1)
    given = edits.select(line, place.cast("bigint").alias("nth"), F.col("end_line") if "end_line" in edits.columns else F.col(line).alias("end_line"), *[(F.col(c) if c in edits.columns else F.lit(None)).cast(t).alias(c) for c, t in EDIT.items() if t])
    listed = given.groupBy(line).agg(F.sort_array(F.collect_list(F.struct("nth", "kind", "sel_start", "sel_end", "style", "color_value", "annotation", "position", (F.col("end_line") != F.col(line)).alias("wide")))).alias("edits"))
    placed = with_offsets(spans, line=line, order=order).where((F.col("type") == "ruby") | (F.length("text") > 0))
    own = F.struct(F.col(order).alias("o"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), (F.col("type") == "ruby").alias("ruby"), shown().alias("text"), F.col("annotations").cast(ANNOTATIONS).alias("annotations"), X.canonical_styles(F.col("styles")).alias("styles"), X.canonical_colour("color").alias("color"))
    lines = placed.groupBy(line).agg(F.sort_array(F.collect_list(own)).alias("spans"))
    folded = F.when(F.col("spans").isNotNull(), _folded(F.col("spans"), F.coalesce("edits", F.array().cast(listed.schema["edits"].dataType))))
    columns = ["start", "part", "text", "annotations", "styles", "color"]
    # outer: else Spark filters by the size of what is to be exploded, and folds each line again for it
    rows = lines.join(listed, line, "left").select(line, folded.alias("folded")).select(line, F.posexplode_outer("folded").alias(order, "p")).where("p is not null").select(line, order, *[F.col(f"p.{c}").alias(c) for c in columns])
    ruby = F.col("part").isNotNull()
    rows = rows.select(line, order, F.when(ruby, "ruby").otherwise("text").alias("type"), F.when(~ruby, F.col("text")).alias("text"), F.when(ruby, F.col("text")).alias("base"), F.when(ruby, F.col("annotations")).alias("annotations"), X.canonical_styles(F.col("styles")).alias("styles"), "color", F.col("part").alias("_part"))
    return _runs(rows, [line], order), _refused(placed, given, line)


def _refused(placed: DataFrame, given: DataFrame, line: str) -> DataFrame:
    """(line, nth, reason) of the annotate edits that can't be carried out.

    Beside the edit itself, a refusal depends on where ruby spans are alone. So their places are all that is folded:
    an annotation that is carried out makes its range one, and a removal takes away the one of just that range.
    """
    place = F.struct(F.col("start").cast("bigint").alias("from"), F.col("end").cast("bigint").alias("to"))
    lines = placed.groupBy(line).agg(F.collect_list(F.when(F.col("type") == "ruby", place)).alias("rubies"), F.max("end").cast("bigint").alias("length"))
    edit = F.struct("nth", "kind", "sel_start", "sel_end", (F.col("end_line") != F.col(line)).alias("wide"))
    listed = given.where(F.col("kind").isin("annotate", "remove")).groupBy(line).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    itself = lambda e: F.when(e.wide, "several lines").when(e.sel_start >= e.sel_end, "empty")

    def step(state: Column, e: Column) -> Column:
        hits = lambda r: F.coalesce((e.sel_start < r.to) & (e.sel_end > r["from"]) & (e.sel_start < e.sel_end), F.lit(False))
        just = lambda r: F.coalesce((r["from"] == e.sel_start) & (r.to == e.sel_end), F.lit(False))
        cuts = F.exists(state.rubies, lambda r: hits(r) & ~just(r))
        begins, ends = F.greatest(e.sel_start, F.lit(0)), F.least(e.sel_end, F.col("length"))
        own = F.filter(F.array(F.struct(begins.alias("from"), ends.alias("to"))), lambda r: e.nth.isNotNull() & (e.sel_start < e.sel_end) & (r["from"] < r.to))
        told = F.when(e.kind == "annotate", itself(e).when(cuts, "cuts a ruby span"))

        def after(reason: Column) -> Column:
            rubies = F.when(e.kind == "remove", F.filter(state.rubies, lambda r: ~just(r))).when(reason.isNull(), F.concat(F.filter(state.rubies, lambda r: ~hits(r)), own)).otherwise(state.rubies)
            return F.struct(rubies.alias("rubies"), F.when(reason.isNull(), state.refused).otherwise(F.array_append(state.refused, F.struct(e.nth.alias("nth"), reason.alias("reason")))).alias("refused"))

        return X.let(told, after)

    start = F.struct(F.col("rubies"), F.array().cast("array<struct<nth:bigint,reason:string>>").alias("refused"))
    unknown = F.transform(F.filter("edits", lambda e: e.kind == "annotate"), lambda e: F.struct(e.nth.alias("nth"), itself(e).otherwise("no such line").alias("reason")))
    rows = listed.join(lines, line, "left").select(line, F.when(F.col("rubies").isNull(), unknown).otherwise(F.aggregate("edits", start, step).refused).alias("refused"))
    # outer: else Spark filters by the size of what is to be exploded, and folds each line again for it
    return rows.select(line, F.explode_outer("refused").alias("r")).where("r is not null").select(line, F.col("r.nth").alias("nth"), F.col("r.reason").alias("reason"))


def _folded(spans: Column, edits: Column) -> Column:
    """The pieces of one line: its spans cut at all borders, and the edits carried out on them in order."""
    borders = F.sort_array(F.array_distinct(F.flatten(F.transform(edits, lambda e: F.array(e.sel_start, e.sel_end)))))

    def cut(s: Column, i: Column, inner: Column) -> Column:
        part = F.when(s.ruby, i.cast("bigint"))

        def piece(points: Column, a: Column, k: Column) -> Column:
            to = F.get(points, (k + 1).cast("int"))
            return F.struct(a.alias("start"), to.alias("end"), part.alias("part"), s.start.alias("from"), s.end.alias("to"), F.substring(s.text, (a - s.start + 1).cast("int"), (to - a).cast("int")).alias("text"), s.annotations.alias("annotations"), s.styles.alias("styles"), s.color.alias("color"))

        points = F.concat(F.array(s.start), F.filter(inner, lambda b: (b > s.start) & (b < s.end)), F.array(s.end))
        return X.let(points, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda a, k: piece(p, a, k)))

    def overlaps(p: Column, e: Column) -> Column:
        return (e.sel_start < p.end) & (e.sel_end > p.start) & (e.sel_start < e.sel_end)

    def changed(p: Column, **values: Column) -> Column:
        return F.struct(*[values.get(c, p[c]).alias(c) for c in ("start", "end", "part", "from", "to", "text", "annotations", "styles", "color")])

    def facts(hit: Column, e: Column) -> Column:
        """What an edit needs to know of the pieces it hits."""
        colours = F.array_distinct(F.transform(hit, lambda p: F.coalesce(p.color, F.lit(""))))
        restyles, notes = e.kind.isin("style", "color"), e.kind == "annotate"
        return F.struct(
            F.when(restyles, F.array_compact(F.transform(hit, lambda p: p.part))).alias("parts"),
            F.when(e.kind == "style", F.forall(hit, lambda p: F.array_contains(p.styles, e.style))).alias("everywhere"),
            F.when(notes, F.exists(hit, lambda p: F.coalesce(p.part.isNotNull() & ((p["from"] != e.sel_start) | (p["to"] != e.sel_end)), F.lit(False)))).alias("cuts"),
            F.when(notes, F.aggregate(hit, F.get(hit, 0).styles, lambda a, p: F.array_intersect(a, p.styles))).alias("shared"),
            F.when(notes, X.let(colours, lambda c: F.when(F.size(c) == 1, F.nullif(F.get(c, 0), F.lit(""))))).alias("colour"),
            F.when(notes, F.array_min(F.transform(hit, lambda p: p.start))).alias("begins"),
            F.when(notes, F.array_max(F.transform(hit, lambda p: p.end))).alias("ends"),
        )

    def carried_out(pieces: Column, e: Column, f: Column) -> Column:
        rival = F.when(e.style == "superscript", "subscript").when(e.style == "subscript", "superscript").otherwise("")
        reason = F.when(e.wide, "several lines").when(e.sel_start >= e.sel_end, "empty").when(f.cuts, "cuts a ruby span")
        note = F.array(F.struct(e.annotation.alias("text"), e.position.alias("position")))

        def after(p: Column) -> Column:
            covered = overlaps(p, e) | F.coalesce(F.array_contains(f.parts, p.part), F.lit(False))
            toggled = F.when(f.everywhere, F.array_remove(p.styles, e.style)).otherwise(F.array_append(F.array_remove(F.array_remove(p.styles, rival), e.style), e.style))
            just = F.coalesce(p.part.isNotNull() & (p["from"] == e.sel_start) & (p["to"] == e.sel_end), F.lit(False))
            return (
                F.when((e.kind == "style") & covered, changed(p, styles=toggled))
                .when((e.kind == "color") & covered, changed(p, color=X.canonical_colour(e.color_value)))
                .when((e.kind == "annotate") & reason.isNull() & overlaps(p, e), changed(p, part=-1 - e.nth, **{"from": f.begins, "to": f.ends}, annotations=note, styles=f.shared, color=f.colour))
                .when((e.kind == "remove") & just, changed(p, part=F.lit(None).cast("bigint"), annotations=F.lit(None).cast(ANNOTATIONS)))
                .otherwise(p)
            )

        return F.transform(pieces, after)

    def step(pieces: Column, e: Column) -> Column:
        hit = F.filter(pieces, lambda p: overlaps(p, e))
        return X.let(hit, lambda h: X.let(facts(h, e), lambda f: carried_out(pieces, e, f)))

    pieces = X.let(borders, lambda inner: F.flatten(F.transform(spans, lambda s, i: cut(s, i, inner))))
    return F.aggregate(edits, pieces, step)


def restyle_ranges(spans: DataFrame, edits: DataFrame, *, line: str = "line", order: str = "ord", nth: str | None = None) -> DataFrame:
    """Lines after style or colour edits (line, sel_start, sel_end, style, set_color, color_value), one a line or several in the order of ``nth``.

    With ``set_color`` the colour becomes ``color_value`` (null clears it) and ``style`` is
    ignored; see ``edit_lines``.
    """
    kind = F.when(F.coalesce("set_color", F.lit(False)), "color").when(F.col("style").isNotNull(), "style")
    return edit_lines(spans, edits.withColumn("kind", kind), line=line, order=order, nth=nth)[0]


def annotate_ranges(spans: DataFrame, edits: DataFrame, *, line: str = "line", order: str = "ord", nth: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical spans after the edits, refused edits with a reason).

    An edit (line, end_line, sel_start, sel_end, annotation, position) makes its range one ruby span;
    see ``edit_lines``. Several edits of a line are told apart by ``nth``.
    """
    done, refused = edit_lines(spans, edits.withColumn("kind", F.lit("annotate")), line=line, order=order, nth=nth)
    return done, refused.select(line, *([F.col("nth").alias(nth)] if nth else []), "reason")


def remove_annotations(spans: DataFrame, ranges: DataFrame, *, line: str = "line", order: str = "ord") -> DataFrame:
    """Ruby spans whose range is exactly one of ``ranges`` (line, start, end) become text; the result is canonical."""
    wanted = ranges.select(line, "start", "end").distinct().withColumn("_wanted", F.lit(True))
    rows = with_offsets(spans, line=line, order=order).join(wanted, [line, "start", "end"], "left")
    hit = (F.col("type") == "ruby") & F.coalesce("_wanted", F.lit(False))
    rows = rows.withColumns({"text": F.when(hit, F.col("base")).otherwise(F.col("text")), "base": F.when(~hit, F.col("base")), "annotations": F.when(~hit, F.col("annotations")), "type": F.when(hit, "text").otherwise(F.col("type"))})
    return coalesce_spans(rows.select(line, order, "type", "text", "base", "annotations", "styles", "color"), line=line, order=order)
