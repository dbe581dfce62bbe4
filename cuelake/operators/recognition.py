"""Recognition: selection of cues, requests, validation of answers and assembly of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions import text as X
from cuelake.sources.shared import checkpointed


def select_cues(cues: DataFrame, wanted: DataFrame | None, overwrite: bool = False, *, cue: str = "cue_id", status: str = "ocr_status") -> tuple[DataFrame, DataFrame | None]:
    """(cues to recognise, wanted ids that no cue has); without ``overwrite`` succeeded cues are left out."""
    unknown = None
    if wanted is not None:
        ids = wanted.select(cue).distinct()
        unknown = ids.join(cues.select(cue), cue, "left_anti")
        cues = cues.join(ids, cue, "left_semi")
    return (cues if overwrite else cues.where(~F.col(status).eqNullSafe(F.lit("succeeded")))), unknown


def resolve_language(df: DataFrame, *, language: str = "language") -> DataFrame:
    """``language_code``, ``reading_order``, ``rejects_controls`` and ``error`` for each row's language alias."""
    code = X.language_code(language)
    return df.withColumn("language_code", code).withColumns({
        "reading_order": F.when(F.col("language_code") == "jpn", "right_to_left").when(F.col("language_code").isNotNull(), "left_to_right"),
        "rejects_controls": F.col("language_code") != "jpn",
        "error": F.when(F.col("language_code").isNull(), F.concat(F.lit("language profile is not supported: "), F.coalesce(F.col(language), F.lit("")))),
    })


def unit_noun(mode: str | Column, plural: bool = True) -> Column:
    end = "s" if plural else ""
    return F.when(X.col(mode) == "vertical_rl", f"column{end}").otherwise(f"row{end}")


def build_requests(blocks: DataFrame, presets: DataFrame, *, language: str = "language_code", mode: str = "writing_mode", units: str = "units", glyphs: str = "expected_glyphs", correction: str = "correction") -> DataFrame:
    """Requests with a ``stable`` part, the same for a language, direction and stage, and a ``variable`` one for the block.

    ``presets`` (language, stage, instructions) is small and fixed. Constant text comes first, so a
    provider can cache it; requests of one prefix should be sent together.
    """
    lang = presets.select(F.col("language").alias("_language"), "stage", "instructions")
    rows = blocks.join(F.broadcast(lang), F.col(language) == F.col("_language")).drop("_language")
    stable = F.to_json(F.struct(F.col("stage"), F.col(language).alias("language"), F.col(mode).alias("writing_mode"), F.col("instructions")))
    count = F.when(F.col(units).isNotNull(), F.concat(F.lit("exactly "), F.col(units).cast("string"), F.lit(" "), unit_noun(mode))).otherwise(F.concat(F.lit("unknown number of "), unit_noun(mode)))
    guide = F.when(F.size(glyphs) > 0, F.concat(F.lit("about "), F.to_json(F.col(glyphs)), F.lit(" characters")))
    return rows.withColumns({"stable": stable, "variable": F.concat_ws("\n", count, guide, F.col(correction))})


def parse_model_json(df: DataFrame, schema: str, *, content: str = "content") -> DataFrame:
    """``parsed`` and ``error``: the answer without its code fence, read by ``schema``; malformed text is an error."""
    body = X.json_body(content)
    valid = F.try_parse_json(body).isNotNull()
    return df.withColumns({"parsed": F.when(valid, F.from_json(body, schema)), "error": F.when(~F.coalesce(valid, F.lit(False)), "model did not return valid JSON")})


def lines_error(lines: Column, expected: Column, noun: Column) -> Column:
    """Why the lines of an answer (normalised text) are rejected, null if they aren't. The messages, as models are corrected with them."""
    n = F.coalesce(F.size(lines), F.lit(0))
    wrong = F.concat(F.lit("bitmap analysis found "), expected.cast("string"), F.lit(" large main-text "), noun, F.lit(" in this block, but the response returned "), n.cast("string"))
    return F.when(n < 1, "main text has no lines").when(expected.isNotNull() & (n != expected), wrong).when(F.exists(lines, lambda t: F.coalesce(F.length(t), F.lit(0)) == 0), "main text line is empty")


def validate_lines(df: DataFrame, *, lines: str = "lines", expected: str = "expected_units", mode: str = "writing_mode") -> DataFrame:
    return df.withColumn("error", lines_error(F.col(lines), F.col(expected), unit_noun(mode)))


def place_annotations(annotations: DataFrame, lines: DataFrame, *, block: str = "block_id", mode: str = "writing_mode") -> DataFrame:
    """Annotations with ``start``, ``end``, ``ruby_position`` and ``error``.

    ``annotations`` are (block, annotation_index, line_index, base, base_occurrence, text, position)
    with normalised text, ``lines`` (block, mode, line_index, line). Ranges on one line may be
    equal but not overlap otherwise. Fixed values: the messages, as models are corrected with them.
    """
    rows = annotations.join(lines.select(block, "line_index", "line"), [block, "line_index"], "left").join(lines.select(block, mode).distinct(), block, "left")
    rows = rows.withColumn("ruby_position", X.ruby_position(mode, "position"))
    start = X.nth_occurrence(F.col("line"), F.col("base"), F.col("base_occurrence"))
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("base"))
    misplaced = F.col("line").isNull() | (F.coalesce("base_occurrence", F.lit(0)) < 1) | F.col("ruby_position").isNull()
    empty = (F.coalesce(F.length("text"), F.lit(0)) == 0) | (F.coalesce(F.length("base"), F.lit(0)) == 0)
    w = Window.partitionBy(block, "line_index").orderBy("start", "end", "annotation_index")
    before_start, before_end = F.lag("start").over(w), F.lag("end").over(w)
    crosses = (F.col("start") < before_end) & ~((F.col("start") == before_start) & (F.col("end") == before_end))
    error = F.when(misplaced, "annotation placement is invalid").when(empty, "annotation text and base must not be empty").when(F.col("start").isNull(), F.concat(F.lit("annotation base was not found: "), F.col("base"))).when(crosses, "ruby ranges overlap")
    return rows.withColumn("error", error)


def validate_annotations(placed: DataFrame, *, block: str = "block_id") -> DataFrame:
    """(block, error): the first error of each block, overlaps last."""
    rank = F.struct((F.col("error") == "ruby ranges overlap").alias("late"), F.col("annotation_index").alias("i"))
    return placed.groupBy(block).agg(F.min_by("error", F.when(F.col("error").isNotNull(), rank)).alias("error"))


def soft_issues(df: DataFrame, *, lines: str = "lines", expected: str = "expected_glyphs", mode: str = "writing_mode", block: str = "block_index") -> DataFrame:
    """``issues`` and ``needs_review``: a length mismatch warns, a vertical block only informs. Fixed value: the message of the former."""
    bad = X.glyph_mismatch(F.col(lines), F.col(expected))
    schema = "struct<code:string,severity:string,stage:string,path:string,message:string,codepoint:string>"

    def issue(code: str, severity: str, stage: str, path: Column, message: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"), path.alias("path"), message.alias("message"), F.lit(None).cast("string").alias("codepoint")).cast(schema)

    message = F.concat(F.lit("Bitmap analysis measured about "), bad.expected.cast("string"), F.lit(" characters in "), unit_noun(mode, False), F.lit(" "), bad.unit.cast("string"), F.lit(", but "), bad.actual.cast("string"), F.lit(" were transcribed."))
    where = F.concat(F.lit("blocks["), F.col(block).cast("string"), F.lit("]"))
    first = F.when(bad.isNotNull(), issue("glyph_count_mismatch", "warning", "main_text_recognition", F.concat(where, F.lit(".lines["), bad.unit.cast("string"), F.lit("]")), message))
    second = F.when(F.col(mode) == "vertical_rl", issue("italic_not_asked", "info", "style_recognition", where, F.lit("Italic is not asked for in a vertical block.")))
    found = F.filter(F.array(first, second), lambda i: i.isNotNull())
    return df.withColumn("issues", found).withColumn("needs_review", F.exists("issues", lambda i: i.severity == "warning"))


def normalize_text(df: DataFrame, *, text: str = "text", japanese: Column | None = None, out: str = "normalized") -> DataFrame:
    """Composed text; where ``japanese`` holds, the three Japanese rules too.

    Rows of ASCII need no composition, so only the others go through Python.
    """
    ascii_only = F.col(text).isNull() | F.col(text).rlike("^\\p{ASCII}*$")
    composed = F.when(ascii_only, F.col(text)).otherwise(X.nfc(F.when(~ascii_only, F.col(text))))
    rows = df.withColumn("_nfc", composed)
    done = F.col("_nfc")
    for _, rule in X.JAPANESE:
        done = rule(done)
    return rows.withColumn(out, F.when(F.lit(False) if japanese is None else japanese, done).otherwise(F.col("_nfc"))).drop("_nfc")


def normalization_log(df: DataFrame, keys: list[str], *, text: str = "text", japanese: Column | None = None) -> DataFrame:
    """(keys, rule, before, after): a row for each rule that changed a text."""
    on = F.lit(True) if japanese is None else japanese
    rows = normalize_text(df, text=text, out="_nfc1").withColumn("_s0", F.col(text)).withColumn("_s1", F.col("_nfc1"))
    rules = ["unicode-nfc"]
    for i, (rule, f) in enumerate(X.JAPANESE, 2):
        rows = rows.withColumn(f"_s{i}", F.when(on, f(F.col(f"_s{i - 1}"))).otherwise(F.col(f"_s{i - 1}")))
        rules.append(rule)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_s{i}").alias("before"), F.col(f"_s{i + 1}").alias("after")) for i, r in enumerate(rules)])
    return rows.select(*keys, F.explode(F.filter(each, lambda e: e.before != e.after)).alias("e")).select(*keys, "e.*")


def reject_controls(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows whose text holds a control character, with its code point."""
    return df.withColumn("codepoint", X.first_control(text)).where("codepoint is not null")


def assemble_spans(lines: DataFrame, placed: DataFrame, *, line: str = "line_id", text: str = "line", italic: str | None = None, color: str | None = None) -> DataFrame:
    """(line, ord, type, text, base, annotations, styles, color) of lines cut at their annotation ranges.

    ``placed`` has (line, start, end, text, position, annotation_index) of annotations without an
    error. Annotations on one range merge; a line without any, also an empty one, is one text span.
    """
    styles = F.when(F.col(italic), F.array(F.lit("italic"))).otherwise(F.array().cast("array<string>")) if italic else F.array().cast("array<string>")
    own = lines.select(line, F.col(text).alias("_line"), styles.alias("styles"), (F.col(color) if color else F.lit(None).cast("string")).alias("color"))
    notes = F.transform(F.array_sort(F.collect_list(F.struct("annotation_index", "text", "position"))), lambda a: F.struct(a.text.alias("text"), a.position.alias("position")))
    ranges = placed.groupBy(line, "start", "end").agg(notes.alias("annotations"))
    listed = ranges.groupBy(line).agg(F.array_sort(F.collect_list(F.struct("start", "end", "annotations"))).alias("_ranges"))
    rows = own.join(listed, line, "left")
    piece = lambda kind, a, b, notes: F.struct(F.lit(kind).alias("type"), a.cast("bigint").alias("from"), b.cast("bigint").alias("to"), notes.alias("annotations"))
    none = F.lit(None).cast("array<struct<text:string,position:string>>")
    before = F.transform("_ranges", lambda r, i: piece("text", F.when(i > 0, F.get(F.col("_ranges"), (i - 1).cast("int")).end).otherwise(F.lit(0)), r.start, none))
    ruby = F.transform("_ranges", lambda r: piece("ruby", r.start, r.end, r.annotations))
    tail = piece("text", F.element_at("_ranges", -1).end, F.length("_line"), none)
    several = F.filter(F.concat(F.flatten(F.zip_with(before, ruby, lambda a, b: F.array(a, b))), F.array(tail)), lambda p: (p["from"] < p["to"]))
    pieces = F.when(F.col("_ranges").isNull() | (F.size("_ranges") < 1), F.array(piece("text", F.lit(0), F.length("_line"), none))).otherwise(several)
    out = rows.select(line, "_line", "styles", "color", F.posexplode(pieces).alias("ord", "p"))
    part = F.substring("_line", (F.col("p.from") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int"))
    return out.select(line, "ord", F.col("p.type").alias("type"), F.when(F.col("p.type") == "text", part).alias("text"), F.when(F.col("p.type") == "ruby", part).alias("base"), F.col("p.annotations").alias("annotations"), "styles", "color")


def assemble_documents(blocks: DataFrame, *, cue: str = "cue_id", order: str = "block_no", model: str = "model", configured: str = "configured_model", unreadable: str = "unreadable", columns: tuple[str, ...] = ("lines",)) -> DataFrame:
    """One document a cue: blocks in order, unreadable if any is, the first model that is named else the configured one."""
    first = F.min_by(model, F.when(F.col(model).isNotNull(), F.col(order)))
    return blocks.groupBy(cue).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda b: F.struct(*[b[c].alias(c) for c in columns])).alias("blocks"), F.bool_or(unreadable).alias("unreadable"), F.coalesce(first, F.min(configured)).alias("model"))


COMPLETION = "choices array<struct<message:struct<content:string>>>, content array<struct<type:string,text:string>>, model string, usage string"


def parse_completions(df: DataFrame, *, body: str = "body", status: str = "http_status") -> DataFrame:
    """``content``, ``model``, ``usage`` and ``error`` of answers in either of two shapes; other statuses than 2xx are errors with an excerpt."""
    b = F.from_json(F.col(body), COMPLETION)
    text = F.try_element_at(F.filter(F.col("_b.content"), lambda c: c.type == "text"), F.lit(1)).text
    ok = F.col(status).between(200, 299)
    rows = df.withColumn("_b", b).withColumn("content", F.when(ok, F.coalesce(F.get(F.col("_b.choices"), F.lit(0)).message.content, text)))
    error = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col(status).cast("string"), F.lit("none")), F.lit(": "), X.error_excerpt(F.coalesce(F.col(body), F.lit(""))))).when(F.col("content").isNull(), "response has no content")
    return rows.withColumns({"model": F.when(ok, F.col("_b.model")), "usage": F.when(ok, F.col("_b.usage")), "error": error}).drop("_b")


USAGE = {
    "input_tokens": ("$.input_tokens", "$.prompt_tokens"), "output_tokens": ("$.output_tokens", "$.completion_tokens"),
    "cache_read_input_tokens": ("$.cache_read_input_tokens", "$.prompt_tokens_details.cached_tokens"),
    "cache_creation_input_tokens": ("$.cache_creation_input_tokens",), "reasoning_tokens": ("$.completion_tokens_details.reasoning_tokens",),
}


def usage_summary(df: DataFrame, *, usage: str = "usage") -> DataFrame:
    """Five token fields of either vendor's usage object, null where it has none."""
    return df.withColumns({k: F.coalesce(*[F.get_json_object(usage, p).try_cast("bigint") for p in paths]) for k, paths in USAGE.items()})


def usage_by_stage(df: DataFrame, keys: tuple[str, ...] = ("stage", "provider", "model")) -> DataFrame:
    """Requests, tokens and share of cached input in thousandths by stage, provider and model."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = df.groupBy(*keys).agg(F.count("*").alias("requests"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cache_read_input_tokens").alias("cache_read_tokens"))
    return rows.withColumn("cache_milli", F.floor(F.col("cache_read_tokens") * 1000 / F.nullif(F.col("input_tokens"), F.lit(0))).cast("bigint"))


def usage_rollup(df: DataFrame, keys: tuple[str, ...] = ("stage", "provider", "model")) -> DataFrame:
    """``usage_by_stage`` with its subtotals, in one aggregation: for each key from the last on, and for all.

    ``level`` tells how many of the keys a row has; the others are null, as a key's own null is not
    (that has its level). Sums and shares are of all requests of a row.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    level = F.lit(len(keys)) - F.bit_count(F.grouping_id())
    rows = df.rollup(*keys).agg(level.cast("int").alias("level"), F.count("*").alias("requests"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cache_read_input_tokens").alias("cache_read_tokens"))
    return rows.withColumn("cache_milli", F.floor(F.col("cache_read_tokens") * 1000 / F.nullif(F.col("input_tokens"), F.lit(0))).cast("bigint"))


def score_batch(requests: DataFrame, backend: Callable[[pd.DataFrame], pd.Series], *, columns: tuple[str, ...] = ("request_id",), prompt: tuple[str, ...] = ("stable", "variable")) -> DataFrame:
    """(columns, response): each request's raw answer. ``backend`` gets batches of requests, sorted so that equal prefixes follow each other."""
    rows = requests.select(*columns, *prompt)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(columns)].assign(response=list(backend(batch)))

    return rows.sortWithinPartitions(prompt[0]).mapInPandas(run, schema)


def retry_rounds(requests: DataFrame, backend: Callable[[pd.DataFrame], pd.Series], judge: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], DataFrame] = lambda answers, attempt: checkpointed(answers), *, max_attempts: int = 2, key: str = "request_id") -> DataFrame:
    """(key, response, error, attempt): rejected answers are asked for again with the last answer and a correction.

    ``judge`` adds ``error`` to (key, response); ``save`` writes a round and reads it back (unless
    given into the shared folder), so that no answer is asked for twice. The driver loop has ``max_attempts`` turns at most; the last failure stands.
    """
    out, todo = None, requests
    for attempt in range(1, max_attempts + 1):
        answered = save(judge(score_batch(todo, backend, columns=(key,))).withColumn("attempt", F.lit(attempt)), attempt)
        done = answered if attempt == max_attempts else answered.where("error is null")
        out = done if out is None else out.unionByName(done)
        failed = answered.where("error is not null").select(key, F.concat(F.lit("\nPrevious answer: "), F.col("response"), F.lit("\nIt was rejected: "), F.col("error")).alias("_more"))
        todo = requests.join(failed, key).withColumn("variable", F.concat("variable", "_more")).drop("_more")
    return out


def recognise(blocks: DataFrame, presets: DataFrame, run_stage: Callable[[DataFrame, str], DataFrame], *, ruby: bool, key: str = "request_id") -> DataFrame:
    """Two phases without a ruby profile (combined, style), else three (main_text, ruby, style), joined by request.

    ``run_stage`` takes the requests of a stage and returns (key, response, error); a later phase
    asks only for blocks whose earlier ones succeeded.
    """
    out, left = None, blocks
    for stage in ("main_text", "ruby", "style") if ruby else ("combined", "style"):
        asked = build_requests(left, presets.where(F.col("stage") == stage))
        answer = run_stage(asked, stage).select(key, F.col("response").alias(stage), F.col("error").alias(f"{stage}_error"))
        out = answer if out is None else out.join(answer, key, "left")
        left = left.join(answer.where(F.col(f"{stage}_error").isNull()).select(key), key, "left_semi")
    return out


def append_attempts(results: DataFrame, *, cue: str = "cue_id", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(attempt rows of all results, revision rows of those that succeeded); one failed cue doesn't stop the others."""
    status = F.when(F.col(error).isNull(), F.when(F.col("needs_review"), "succeeded_with_warning").otherwise("succeeded")).otherwise("failed")
    attempts = results.select(cue, "run_id", F.lit(1).alias("attempt_number"), status.alias("status"), F.when(F.col(error).isNull(), F.col("document")).alias("candidate"), F.col(error).alias("error"))
    revisions = results.where(F.col(error).isNull()).select(cue, F.lit("ocr").alias("author"), "start_ms", "end_ms", "document")
    return attempts, revisions


def redact_profiles(df: DataFrame, *, provider: str = "provider", url: str = "base_url", model: str = "model", secret: str = "api_key") -> DataFrame:
    """Profiles without their key, and the backend's identity: provider, address without trailing slashes, model."""
    return df.withColumn("identity", F.concat_ws(":", provider, F.rtrim(F.col(url), F.lit("/")), model)).withColumn(secret, F.lit(None).cast("string"))
