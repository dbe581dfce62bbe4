"""Registered queries on files and streams: the given tables are written as a store, as log segments or as exports and read again, or read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import export
from cuelake.plans.adapters import Tables
from cuelake.plans.queries import SQL, query, said_segments, stream_files
from cuelake.sources import named_texts, readers, segments, sinks
from cuelake.sources.shared import own_folder
from cuelake.streaming import feeds, jobs, keyed


def streamed(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream of rows has written once all that is there was read."""
    if mode == "append":
        writer = rows.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        writer = rows.writeStream.foreachBatch(lambda part, n: part.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}"))
    writer.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/out")


class Streams(Tables):
    """Tables whose events arrive as a stream."""

    def read(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name[:-1]}[{name[-1]}].parquet")  # a pattern: a table may be a file, and a stream takes only folders by name


@query("select cast(user_id % 5 as varchar) as project_id, cast(cue_id as varchar) as cue_id, append_seq, author from v_revisions where user_id % 5 = 3")
def evidence_store(t: Tables) -> DataFrame:
    """One project's revisions from a store in folders by project."""
    folder = own_folder(t.spark, "evidence")
    rows = t.revisions().select((F.col("user_id") % 5).cast("string").alias("project_id"), "append_seq", F.col("cue_id").cast("string").alias("cue_id"), "author")
    sinks.append_evidence(rows, f"{folder}/cue_revisions")
    return readers.read_evidence(t.spark, folder, ("cue_revisions",))["cue_revisions"].where("project_id = '3'").select("project_id", "cue_id", "append_seq", "author")


def entries(t: Tables) -> DataFrame:
    d = t.diagnostics()
    return d.select(F.col("session_id").cast("string").alias("session_id"), "sequence", "level", "source", "phase", F.concat(F.lit("at "), F.col("at_ms").cast("string")).alias("message"), F.lit('{"api_key":"k","n":1}').alias("details"))


@query("select cast(session_id as varchar) as session_id, sequence, level, 'at ' || cast(at_ms as varchar) as message from v_diag")
def diagnostic_files(t: Tables) -> DataFrame:
    folder = own_folder(t.spark, "log")
    entries(t).write.json(folder)
    return readers.read_diagnostics(t.spark, folder).select("session_id", "sequence", "level", "message")


@query("""select cast(session_id as varchar) as session_id, sequence, level, '{"api_key":"[REDACTED]","n":1}' as details from v_diag""")
def streamed_tail(t: Tables) -> DataFrame:
    folder = own_folder(t.spark, "tail")
    entries(t).write.json(f"{folder}/log")
    tail = feeds.stream_log_tail(t.spark, f"{folder}/log", pattern="part-*")
    return streamed(tail, folder).select("session_id", "sequence", "level", "details")


@query("""select track_id, string_agg(cast(seq as varchar) || ' ' || said, chr(10) order by seq) as said from (select track_id, row_number() over (partition by track_id order by start_ms, end_ms, cue_index) as seq, cue_index % 5 as said from v_cues where text is not null) group by 1""")
def srt_files(t: Tables) -> DataFrame:
    """A file a track, read again as one text."""
    folder = own_folder(t.spark, "srt")
    rows = t.cues().where("text is not null").withColumn("said", (F.col("cue_index") % 5).cast("string"))
    numbers = export.render_text(rows, "said", track="track_id", start="start_ms", end="end_ms", index="cue_index")
    sinks.write_srt(numbers.select("track_id", "seq", F.concat_ws(" ", F.col("seq").cast("string"), (F.col("cue_index") % 5).cast("string")).alias("entry")), folder)
    files = t.spark.read.text(folder, wholetext=True)
    return files.select(F.col("track_id").cast("bigint").alias("track_id"), F.regexp_replace("value", "\\n$", "").alias("said"))


@query("select level, count(*) as entries from v_diag group by 1")
def survey_report(t: Tables) -> DataFrame:
    folder = own_folder(t.spark, "report")
    sinks.write_survey(t.diagnostics().groupBy("level").agg(F.count("*").alias("entries")), folder)
    return t.spark.read.json(folder).select("level", "entries")


@query("select cue_id, append_seq, author, document from v_effective")
def streamed_effective(t: Tables) -> DataFrame:
    """The effective revisions of a stream of revisions, from the table that it keeps up to date."""
    folder = own_folder(t.spark, "effective")
    table = keyed.KeyedTable(t.spark, f"{folder}/table", "cue_id bigint, append_seq bigint, author string, document string", buckets=8)
    keyed.follow(Streams(t.spark, t.folder).revisions(), table, f"{folder}/checkpoint").awaitTermination()
    return table.read()


def with_rocksdb(t: Tables, build) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    jobs.use_rocksdb(t.spark)
    try:
        return build()
    finally:
        t.spark.conf.set(key, before)


def job_events(t: Tables) -> DataFrame:
    phase = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    return t.log().select(F.col("user_id").alias("job_id"), "append_seq", phase.alias("phase"), (F.col("append_seq") % 1000).cast("int").alias("current"), "cue_id")


@query("select cast(user_id as varchar) as job_id, arg_max(case event_type when 'purchase' then 'completed' else event_type end, append_seq) as phase, arg_max(append_seq % 1000, append_seq)::int as current, count(distinct cue_id) filter (event_type = 'purchase') as completed from v_log group by 1")
def streamed_progress(t: Tables) -> DataFrame:
    """The batch log holds even jobs' first half; the stream brings the rest."""
    folder = own_folder(t.spark, "progress")
    early = "append_seq % 4 = 0"
    build = lambda: streamed(jobs.stream_job_progress(job_events(Streams(t.spark, t.folder)).where(f"not {early}"), log=job_events(t).where(early)), folder, "update")
    told = with_rocksdb(t, build)
    return told.groupBy("job_id").agg(F.max_by(F.struct("phase", "current", "completed"), "batch").alias("r")).select("job_id", "r.phase", "r.current", "r.completed")


@query("""select cast(user_id as varchar) as job_id, 'interrupted' as status, max(at_ms) as last_ms from v_log group by user_id having arg_max(event_type, (at_ms, append_seq)) <> 'purchase' and max(at_ms) + 86400000 <= (select max(at_ms) from v_log)""")
def streamed_stale(t: Tables) -> DataFrame:
    """Users as jobs: silent for a day before the log ends, and not through a purchase."""
    folder = own_folder(t.spark, "stale")
    events = Streams(t.spark, t.folder).log().select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.timestamp_millis(F.col("at_ms") + 1_704_067_200_000).alias("at"))
    told = with_rocksdb(t, lambda: streamed(jobs.stream_stale_jobs(events, 86_400), folder))
    return told.select("job_id", "status", (F.unix_millis("last_at") - 1_704_067_200_000).alias("last_ms"))


CANONICAL = """select track_id, '{"format":"subtitle-evidence","version":2,"track_id":' || cast(track_id as varchar) || ',"cues":[' || string_agg('{"start_ms":' || cast(start_ms as varchar) || ',"end_ms":' || cast(end_ms as varchar) || ',"cue_index":' || cast(cue_index as varchar) || ',"role":"' || role || '"}', ',' order by start_ms, end_ms, cue_index, role) || ']}' as document from v_cues group by 1"""


@query(CANONICAL)
def canonical_files(t: Tables) -> DataFrame:
    """Documents put together from pieces, one file a track, read again."""
    folder = own_folder(t.spark, "documents")
    sinks.write_documents(export.canonical_lines(t.cues(), more=("role",)), folder)
    files = t.spark.read.text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("bigint").alias("track_id"), F.col("value").alias("document"))


def segment_files(t: Tables) -> DataFrame:
    """The streams of ``sup_segments`` as files, read in ranges of 97 bytes."""
    folder = own_folder(t.spark, "streams")
    files = stream_files(t).select(F.concat("path", F.lit(".sup")).alias("name"), F.lit(0).alias("place"), F.col("content").alias("value"))
    named_texts.write_named(files, folder)
    found = segments.read_sup_segments(t.spark, f"{folder}/*.sup", 97)
    return said_segments(found.withColumn("path", F.regexp_extract("path", r"(\d+)\.sup$", 1)))


query()(segment_files)
SQL["segment_files"] = SQL["sup_segments"]


@query("""select cue_id, case when cue_index = 1 then 'image not found' when cue_index = 2 then 'image path leaves the project' end as error, case when cue_index not in (1, 2) then sha256(coalesce(text, '')) end as digest from v_cues""")
def cue_images(t: Tables) -> DataFrame:
    """Texts stand for images; of each track one file is missing and one path leads outside."""
    folder = own_folder(t.spark, "images")
    named_texts.write_named(t.cues().where("cue_index <> 1").select(F.concat(F.col("cue_id").cast("string"), F.lit(".png")).alias("name"), F.lit(0).alias("place"), "text"), f"{folder}/assets/cues/x", value="text")
    path = F.concat(F.when(F.col("cue_index") == 2, "assets/cues/../").otherwise("assets/cues/x/"), F.col("cue_id").cast("string"), F.lit(".png"))
    found = readers.read_cue_images(t.spark, folder, t.cues().select("cue_id", path.alias("image_path")))
    return found.select("cue_id", "error", F.sha2("image", 256).alias("digest"))
