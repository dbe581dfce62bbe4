"""Translation: which cues to translate, with what context, and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions import text as X
from cuelake.operators.evidence import effective_revision, translation_source


def select_translation(cues: DataFrame, revisions: DataFrame, wanted: DataFrame | None = None, overwrite: bool = False, *, cue: str = "cue_id", seq: str = "append_seq") -> tuple[DataFrame, DataFrame | None]:
    """(cues with a source and its number, wanted ids that no cue has); cues whose newest revision is a translation are left out unless ``overwrite``."""
    unknown = None
    if wanted is not None:
        ids = wanted.select(cue).distinct()
        unknown = ids.join(cues.select(cue), cue, "left_anti")
        cues = cues.join(ids, cue, "left_semi")
    source = translation_source(revisions, cue=cue, seq=seq).select(cue, F.col(seq).alias("source_seq"))
    rows = cues.join(source, cue)
    if not overwrite:
        translated = effective_revision(revisions, cue=cue, seq=seq).where("author = 'translation'").select(cue)
        rows = rows.join(translated, cue, "left_anti")
    return rows, unknown


def neighbour_context(cues: DataFrame, sources: DataFrame, *, track: str = "track_id", index: str = "cue_index", cue: str = "cue_id", text: str = "text") -> DataFrame:
    """Each cue with the source text of the cue before and after it in the track; null if that very neighbour has none."""
    w = Window.partitionBy(track).orderBy(index)
    rows = cues.join(sources.select(cue, F.col(text).alias("_text")), cue, "left")
    return rows.withColumns({"previous_context": F.lag("_text").over(w), "next_context": F.lead("_text").over(w)}).drop("_text")


def translation_requests(cues: DataFrame, glossary: DataFrame, *, project: str = "project_id", blocks: str = "blocks") -> DataFrame:
    """``stable`` (task, languages, glossary) and ``variable`` (neighbours and numbered lines) of each cue."""
    nouns = glossary.groupBy(project).agg(F.array_sort(F.collect_list(F.struct("source", "translation"))).alias("_nouns"))
    rows = cues.join(nouns, project, "left")
    empty = F.array().cast("array<struct<source:string,translation:string>>")
    stable = F.to_json(F.struct(F.lit("translate_subtitle_cue").alias("task"), "source_language", "target_language", F.coalesce("_nouns", empty).alias("proper_noun_mappings")))
    lines = lambda b: F.transform(b["lines"], lambda x, i: F.struct((i + 1).alias("line_index"), x.text.alias("text")))
    numbered = F.transform(blocks, lambda b, i: F.struct((i + 1).alias("block_index"), b.writing_mode.alias("writing_mode"), lines(b).alias("lines")))
    variable = F.to_json(F.struct(F.col("previous_context").alias("previous_cue_context"), F.col("next_context").alias("next_cue_context"), numbered.alias("blocks")), {"ignoreNullFields": "false"})
    return rows.withColumns({"stable": stable, "variable": variable}).drop("_nouns")


def validate_translation(expected: DataFrame, received: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    """(cue, error): the first error of each expected cue, null if every line came back once and isn't empty.

    ``expected`` and ``received`` have (cue, block_index, line_index), received also ``text``; indices
    from 1. A block that doesn't belong comes before a wrong number of lines, then misplaced, empty
    and repeated lines.
    """
    shape = expected.groupBy(cue, "block_index").agg(F.count("*").alias("lines"))
    size = shape.groupBy(cue).agg(F.count("*").alias("blocks"))
    answer = received.groupBy(cue, "block_index", "line_index").agg(F.count("*").alias("times"), F.min(F.length(X.trim_unicode("text"))).alias("shortest"))
    per_block = answer.groupBy(cue, "block_index").agg(F.sum("times").alias("got"), F.max("line_index").alias("high"), F.min("line_index").alias("low"), F.max("times").alias("times"), F.min(F.coalesce("shortest", F.lit(0))).alias("shortest"))
    both = shape.join(per_block, [cue, "block_index"], "full_outer")
    error = (
        F.when(F.col("lines").isNull(), "block index is out of range").when(F.col("got").isNull(), "block mapping is incomplete")
        .when(F.col("got") != F.col("lines"), F.format_string("expected %d lines, received %d", "lines", "got"))
        .when((F.col("low") < 1) | (F.col("high") > F.col("lines")), "line index is out of range")
        .when((F.col("shortest") < 1) | (F.col("times") > 1), "line mapping is empty or duplicated")
    )
    first = both.withColumn("error", error).groupBy(cue).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("block_index"))).alias("_first"), F.count("got").alias("_received"))
    counted = F.format_string("expected %d blocks, received %d", "blocks", "_received")
    return size.join(first, cue, "left").select(cue, F.when(F.col("_received") != F.col("blocks"), counted).otherwise(F.col("_first")).alias("error"))


def apply_translation(documents: DataFrame, received: DataFrame, *, cue: str = "cue_id", blocks: str = "blocks") -> DataFrame:
    """Documents with the received lines for their text; a line keeps its styles or colour only if all its spans share them.

    ``received`` (cue, block_index, line_index, text) has passed ``validate_translation``.
    """
    texts = received.groupBy(cue).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "block_index", "line_index"), X.trim_unicode("text")))).alias("_texts"))

    def line(x: Column, b: Column, i: Column) -> Column:
        new = F.element_at(F.col("_texts"), F.concat_ws(":", (b + 1).cast("string"), (i + 1).cast("string")))
        uniform = lambda f: F.size(F.array_distinct(F.transform(x.spans, f))) == 1
        first = F.try_element_at(x.spans, F.lit(1))
        styles = F.when(uniform(lambda s: F.array_join(s.styles, ",")), first.styles).otherwise(F.array().cast("array<string>"))
        color = F.when(uniform(lambda s: F.coalesce(s.color, F.lit(""))), first.color)
        span = F.struct(F.lit("text").alias("type"), new.alias("text"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("array<struct<text:string,position:string>>").alias("annotations"), styles.alias("styles"), color.alias("color"))
        return F.struct(new.alias("text"), F.array(span).alias("spans"))

    changed = F.transform(blocks, lambda b, i: b.withField("lines", F.transform(b["lines"], lambda x, j: line(x, i, j))))
    return documents.join(texts, cue).withColumn(blocks, changed).drop("_texts")


def _grams(text: Column, least: int, most: int) -> Column:
    """The distinct runs of ``least`` to ``most`` characters of a text, each length in one pass."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(least, most + 1)]
    return F.array_distinct(F.concat(*runs))


def _is_small(df: DataFrame) -> bool:
    """Whether Spark's estimate of a table is within its own limit of what it broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def glossary_hits(texts: DataFrame, glossary: DataFrame, *, keys: tuple[str, ...], text: str = "text", translation: str | None = None, term: str = "source", mapped: str | None = None, project: str | None = None) -> DataFrame:
    """(keys, term) of each glossary term that a text contains, with ``translated`` if the mapped form occurs in the translation.

    With ``project`` only terms of the text's project count; a project has 500 of them at most, so they
    are one array that the texts of the project get by a join. Without, terms are looked up under one
    of their trigrams, that which the fewest terms have. A glossary below Spark's broadcast limit is
    broadcast to the texts; of a larger one ids and trigrams of texts meet the terms in a shuffle, and
    texts meet their candidates again by ``keys`` and a hash. Terms of one or two characters are met
    by runs of that length, an empty term by every text.
    """
    terms = glossary.select((F.col(project) if project else F.lit(0)).alias("_of"), F.col(term).alias("_term"), (F.col(mapped) if mapped else F.lit(None).cast("string")).alias("_mapped")).where("_term is not null")
    rows = texts.select(F.struct(*keys).alias("_keys"), (F.col(project) if project else F.lit(0)).alias("_in"), F.col(text).alias("_text"), (F.col(translation) if translation else F.lit(None).cast("string")).alias("_said"), F.xxhash64(text).alias("_hash"))
    if project:
        rows = rows.join(terms.groupBy("_of").agg(F.collect_list(F.struct("_term", "_mapped")).alias("_list")), F.col("_in") == F.col("_of"))
        found = F.filter("_list", lambda e: F.col("_text").contains(e["_term"]))
        hits = rows.select("_keys", "_said", F.explode(found).alias("_e")).select("_keys", "_said", "_e.*")
    else:
        hits = _looked_up(rows.where("_text is not null"), terms, _is_small(glossary)).where(F.col("_text").contains(F.col("_term")))
    extra = [F.col("_said").contains(F.col("_mapped")).alias("translated")] if translation and mapped else []
    return hits.select("_keys.*", F.col("_term").alias("term"), *extra)


def _looked_up(rows: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """``rows`` with each term (and its mapped form) that they may contain, as often as it is listed."""
    terms = terms.groupBy("_term", "_mapped").agg(F.count("*").alias("_times"))
    own = terms.where(F.length("_term") >= 3).withColumn("_gram", F.explode(_grams(F.col("_term"), 3, 3)))
    common = own.groupBy(F.col("_gram").alias("_g")).agg(F.count("*").alias("_n"))
    rare = own.join(common, F.col("_gram") == F.col("_g")).groupBy("_term", "_mapped", "_times").agg(F.min(F.struct("_n", "_gram")).getField("_gram").alias("_gram"))
    short = terms.where(F.length("_term") < 3).select("_term", "_mapped", "_times", F.col("_term").alias("_gram"))

    def met(listed: DataFrame, grams: Column) -> DataFrame:
        if small:
            return rows.withColumn("_has", F.explode(grams)).join(F.broadcast(listed), F.col("_has") == F.col("_gram")).drop("_has", "_gram")
        ids = rows.select("_keys", "_hash", F.explode(grams).alias("_has")).distinct()
        return ids.join(listed.hint("shuffle_hash"), F.col("_has") == F.col("_gram")).select("_keys", "_hash", "_term", "_mapped", "_times")

    found = met(rare, _grams(F.col("_text"), 3, 3)).unionByName(met(short, F.concat(F.array(F.lit("")), _grams(F.col("_text"), 1, 2))))
    return (found if small else rows.join(found.hint("merge"), ["_keys", "_hash"])).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
