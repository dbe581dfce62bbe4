"""Evidence log: effective revisions, decisions and the current state of cues.

All logs are append-only and ordered by ``seq``, never by a timestamp. Functions take column
names as parameters, so that they run on any table with such columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.operators.numbering import numbered
from cuelake.sources.shared import checkpointed

CURRENT_SCHEMA = 2
AUTHORS = ("ocr", "human", "translation")


def newest(df: DataFrame, keys: str | Sequence[str], seq: str = "append_seq", where: Column | str | None = None, place: int = 1) -> DataFrame:
    """The row of each key that was appended last (or the ``place``-th last), among those that ``where`` lets pass.

    The ranking filter becomes a group limit on both sides of the exchange, so a cue with a very
    long history sends few rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df if where is None else df.where(where)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(seq).desc()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == place).drop("_rank")


def effective_revision(revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq") -> DataFrame:
    """The newest revision of each cue, whoever wrote it."""
    return newest(revisions, cue, seq)


def latest_recognition(revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", author: str = "author") -> DataFrame:
    return newest(revisions, cue, seq, F.col(author) == "ocr")


def translation_source(revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", author: str = "author") -> DataFrame:
    """The newest revision that is not itself a translation."""
    return newest(revisions, cue, seq, F.col(author) != "translation")


def winners_then_payload(revisions: DataFrame, payload: Sequence[str], *, cue: str = "cue_id", seq: str = "append_seq") -> DataFrame:
    """``effective_revision`` for wide documents: only ids are ranked, the documents follow by a join."""
    ids = revisions.groupBy(cue).agg(F.max(seq).alias(seq))
    return revisions.select(cue, seq, *payload).join(ids, [cue, seq], "left_semi")


def effective_document(cues: DataFrame, revisions: DataFrame, recognitions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", document: str = "document") -> DataFrame:
    """Each cue with its latest revision's document, else its latest recognition's, else null, and where it comes from."""
    a = newest(revisions, cue, seq).select(cue, F.col(document).alias("_revised"), F.lit(True).alias("_has_revision"))
    b = newest(recognitions, cue, seq).select(cue, F.col(document).alias("_recognised"), F.lit(True).alias("_has_recognition"))
    origin = F.when(F.col("_has_revision"), "revision").when(F.col("_has_recognition"), "recognition")
    chosen = F.when(F.col("_has_revision"), F.col("_revised")).otherwise(F.col("_recognised"))
    return cues.join(a, cue, "left").join(b, cue, "left").withColumns({document: chosen, "origin": origin}).drop("_revised", "_recognised", "_has_revision", "_has_recognition")


def revision_counts(revisions: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    return revisions.groupBy(cue).agg(F.count("*").alias("revisions"))


def revision_history(revisions: DataFrame, cues: DataFrame, wanted: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq") -> tuple[DataFrame, DataFrame]:
    """(history newest first of the wanted cues, wanted ids that no cue has)."""
    unknown = wanted.select(cue).distinct().join(cues.select(cue), cue, "left_anti")
    return revisions.join(wanted.select(cue).distinct(), cue, "left_semi").orderBy(cue, F.col(seq).desc()), unknown


def delete_revisions(revisions: DataFrame, target: Column, *, cue: str = "cue_id") -> DataFrame:
    """Every revision with ``outcome`` kept, deleted or refused.

    A deletion that would leave a cue without a revision is refused for all of the cue's targets.
    """
    w = Window.partitionBy(cue)
    hit = F.coalesce(target, F.lit(False))
    left = F.count("*").over(w) - F.count_if(hit).over(w)
    return revisions.withColumn("outcome", F.when(~hit, "kept").when(left >= 1, "deleted").otherwise("refused"))


def next_numbers(rows: DataFrame, log: DataFrame, *, keys: Sequence[str], seq: str = "append_seq", project: str = "project_id", tasks: int | None = None) -> DataFrame:
    """Rows with numbers that go on from each project's highest, in the order of ``keys``; a project of any size is spread over tasks."""
    last = log.groupBy(F.col(project).alias("_project")).agg(F.max(seq).alias("_last"))
    told = numbered(rows, [project], keys, "_nth", tasks=tasks).join(last, F.col(project).eqNullSafe(F.col("_project")), "left")
    return told.withColumn(seq, F.coalesce("_last", F.lit(0)) + F.col("_nth")).drop("_project", "_last", "_nth")


def append_revisions(documents: DataFrame, log: DataFrame, author: str, *, keys: Sequence[str], seq: str = "append_seq", project: str = "project_id", tasks: int | None = None) -> DataFrame:
    """The documents as new rows of the log; numbers go on from each project's highest, in the order of ``keys``."""
    return next_numbers(documents, log, keys=keys, seq=seq, project=project, tasks=tasks).withColumns({"author": F.lit(author), "review_status": F.lit("unreviewed")})


def live_revisions(log: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", kind: str = "kind", reference: str = "revision_seq", arranged: bool = False) -> DataFrame:
    """The revisions of a mixed log that no deletion names; what every operator on revisions then takes.

    A deletion is a row of its own that names a cue's revision by number. Rows are dealt by cue once
    and stay so: the newest live revision of a cue needs no second exchange, and none at all where
    ``arranged`` says that a cue's rows are together already, as in a bucketed table. A deletion of
    a number that the cue does not have, or a second one of the same revision, changes nothing.
    """
    rows = log.where(F.col(kind).isin("revision", "deletion"))
    rows = rows if arranged else rows.repartition(cue)
    deletes = F.col(kind) == "deletion"
    named = F.when(deletes, F.col(reference)).otherwise(F.col(seq))
    gone = F.max(deletes).over(Window.partitionBy(cue, named))
    return rows.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone")


def delete_from_log(log: DataFrame, target: Column, *, cue: str = "cue_id", seq: str = "append_seq", kind: str = "kind", reference: str = "revision_seq", project: str = "project_id", arranged: bool = False, tasks: int | None = None) -> DataFrame:
    """New deletion rows (project, cue, number, kind, reference) for the targets that may go, to be appended to the log.

    Only live revisions are targets, and a cue keeps one of them (see ``delete_revisions``). Their
    numbers go on from the project's highest, by cue and revision.
    """
    judged = delete_revisions(live_revisions(log, cue=cue, seq=seq, kind=kind, reference=reference, arranged=arranged), target, cue=cue)
    gone = checkpointed(judged.where("outcome = 'deleted'").select(project, cue, F.col(seq).alias(reference), F.lit("deletion").alias(kind)))  # few and narrow; numbering looks for the borders of its ranges in a pass of its own
    return next_numbers(gone, log, keys=[cue, reference], seq=seq, project=project, tasks=tasks)


def restore_to_ocr(cues: DataFrame, revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq") -> DataFrame:
    """Documents for new human revisions: the latest recognition with the cue's own times."""
    source = latest_recognition(revisions, cue=cue, seq=seq).drop("start_ms", "end_ms", seq, "author")
    return cues.select(cue, "start_ms", "end_ms").join(source, cue).withColumn("author", F.lit("human"))


def restore_revision(revisions: DataFrame, requests: DataFrame, *, cue: str = "cue_id", revision: str = "append_seq") -> tuple[DataFrame, DataFrame]:
    """(copies to append as human revisions, requests whose revision isn't the cue's)."""
    copies = revisions.join(requests.select(cue, revision).distinct(), [cue, revision], "left_semi").withColumn("author", F.lit("human")).withColumnRenamed(revision, "restored_from")
    return copies, requests.join(revisions.select(cue, revision), [cue, revision], "left_anti")


def undo_target(revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq") -> DataFrame:
    """For each cue with two revisions or more, the one that undo copies and the one it replaces."""
    w = Window.partitionBy(cue).orderBy(seq)
    rank = F.row_number().over(Window.partitionBy(cue).orderBy(F.col(seq).desc()))
    rows = revisions.withColumns({"restores": F.lag(seq).over(w), "_rank": rank}).where("_rank = 1 and restores is not null")
    return rows.select(cue, F.col(seq).alias("replaces"), "restores")


def append_decisions(reviews: DataFrame, revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", note: str = "note") -> tuple[DataFrame, DataFrame]:
    """(decisions bound to the revision effective now, refused reviews with a reason). Notes are trimmed, empty ones null."""
    now = effective_revision(revisions, cue=cue, seq=seq).select(cue, F.col(seq).alias("revision_seq"))
    trimmed = F.nullif(F.regexp_replace(note, r"(?U)^\s+|\s+$", ""), F.lit(""))
    rows = reviews.withColumn(note, trimmed).join(now, cue, "left")
    reason = F.when(F.col("revision_seq").isNull(), "no revision").when(F.length(note) > 2000, "note too long")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def latest_decision(decisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq") -> DataFrame:
    return newest(decisions, cue, seq)


def valid_approvals(decisions: DataFrame, revisions: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", status: str = "status", bound_to: str = "revision_seq") -> DataFrame:
    """Latest decisions that approve the revision effective now; an approval of an older one has lapsed."""
    now = revisions.groupBy(cue).agg(F.max(seq).alias("_now"))  # numbers alone, so nothing has to be ranked
    latest = latest_decision(decisions, cue=cue, seq=seq).where(F.col(status) == "approved")
    return latest.join(now, cue).where(F.col(bound_to).between(F.col("_now"), F.col("_now"))).drop("_now")  # as an equality the number would become a join key, and both sides be dealt again


def bind_decisions(log: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", kind: str = "kind") -> DataFrame:
    """The decisions of a mixed log with the revision that was effective when each was taken (as-of)."""
    before = Window.partitionBy(cue).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = log.where(F.col(kind).isin("revision", "decision"))
    return rows.withColumn("revision_seq", F.last(F.when(F.col(kind) == "revision", F.col(seq)), ignorenulls=True).over(before)).where(F.col(kind) == "decision")


def cue_state(log: DataFrame, *, cue: str = "cue_id", seq: str = "append_seq", kind: str = "kind", status: str = "status") -> DataFrame:
    """(cue, ocr_status, review_status) folded from attempts, revisions, deletions and decisions.

    A successful attempt sets needs_review if it has a warning (status ``succeeded_with_warning``),
    else unreviewed; a failed one leaves the review alone; a revision or deletion makes the cue
    unreviewed; a decision sets its own status.
    """
    k, s = F.col(kind), F.col(status)
    ocr = F.when((k == "attempt") & s.startswith("succeeded"), "succeeded").when(k == "attempt", "failed")
    review = F.when(k == "decision", s).when(k.isin("revision", "deletion"), "unreviewed").when((k == "attempt") & (s == "succeeded_with_warning"), "needs_review").when((k == "attempt") & (s == "succeeded"), "unreviewed")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(seq)))
    return log.groupBy(cue).agg(F.coalesce(last(ocr), F.lit("pending")).alias("ocr_status"), F.coalesce(last(review), F.lit("unreviewed")).alias("review_status"))


def project_statistics(states: DataFrame, *, project: str = "project_id") -> DataFrame:
    """Cues, recognised cues and approved cues of each project, in one pass."""
    return states.groupBy(project).agg(F.count("*").alias("cues"), F.count_if(F.col("ocr_status") == "succeeded").alias("succeeded"), F.count_if(F.col("review_status") == "approved").alias("approved"))


def check_uniques(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def check_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key no parent has; null keys refer to nothing."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def cascade_delete(child: DataFrame, removed: DataFrame, child_key: str, removed_key: str) -> DataFrame:
    """``child`` without the rows that belong to a removed parent."""
    return child.join(removed.select(F.col(removed_key).alias("_gone")), F.col(child_key) == F.col("_gone"), "left_anti")


def unlink_deleted(decisions: DataFrame, revisions: DataFrame, *, reference: str = "revision_seq", revision: str = "append_seq") -> DataFrame:
    """Decisions whose revision is gone keep their status but lose the reference."""
    present = revisions.select(F.col(revision).alias("_present")).distinct()
    return decisions.join(present, F.col(reference) == F.col("_present"), "left").withColumn(reference, F.when(F.col("_present").isNotNull(), F.col(reference))).drop("_present")


def gate_schema_version(projects: DataFrame, *, version: str = "schema_version") -> DataFrame:
    """Projects with ``error``: null if their version is the current one."""
    message = F.format_string("schema version %s, expected %d", F.coalesce(F.col(version).cast("string"), F.lit("none")), F.lit(CURRENT_SCHEMA))
    return projects.withColumn("error", F.when(~F.col(version).eqNullSafe(F.lit(CURRENT_SCHEMA)), message))


def fork_project(tables: dict[str, DataFrame], project_id: str, new_id: str, name: str) -> dict[str, DataFrame]:
    """The rows of one project in every table under a new id; the project row records its origin."""
    out = {}
    for table, df in tables.items():
        rows = df.where(F.col("project_id") == project_id).withColumn("project_id", F.lit(new_id))
        if table == "projects":
            rows = rows.withColumns({"name": F.lit(name), "origin": F.struct(F.lit(project_id).alias("project_id"), F.col("path") if "path" in df.columns else F.lit(None).cast("string").alias("path"), F.current_timestamp().alias("cloned_at"))})
        out[table] = rows
    return out


def project_document(projects: DataFrame, lists: dict[str, tuple[DataFrame, Sequence[str]]], *, project: str = "project_id") -> DataFrame:
    """Each project with one array for each table of ``lists`` {name: (table, sort columns first)}.

    Every list is aggregated before its join, so no list multiplies another.
    """
    out = projects
    for name, (df, columns) in lists.items():
        one = df.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(one, project, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(one.schema[name].dataType)))
    return out


def normalize_settings(mappings: DataFrame, *, project: str = "project_id", source: str = "source", translation: str = "translation", order: str = "position") -> DataFrame:
    """Glossary mappings trimmed, each with ``error`` (null if it may stay): length, control characters, repeats, number."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = mappings.withColumns({source: trim(source), translation: trim(translation)})
    bad = lambda c: (F.length(c) < 1) | (F.length(c) > 200) | F.col(c).rlike(r"\p{Cc}")
    nth = F.row_number().over(Window.partitionBy(project, source).orderBy(order))
    total = F.count("*").over(Window.partitionBy(project))
    error = F.when(total > 500, "more than 500 mappings").when(bad(source) | bad(translation), "not 1 to 200 visible characters").when(nth > 1, "mapped more than once")
    return rows.withColumn("error", error)


def language_setting(value: Column) -> Column:
    """The trimmed language, or null if it isn't 1 to 32 visible characters."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(trimmed).between(1, 32) & ~trimmed.rlike(r"\p{Cc}"), trimmed)
