"""Scans: evidence tables, streams of segments, images, listings and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.text import trim_unicode
from cuelake.sources.segments import read_sup_segments, segments_of  # noqa: F401
from cuelake.sources.tail import GrowingLines

SPAN = "struct<type:string,text:string,base:string,annotations:array<struct<text:string,position:string>>,styles:array<string>,color:string>"
LINE = f"struct<text:string,spans:array<{SPAN}>>"
BLOCK = f"struct<bounds:struct<x:int,y:int,width:int,height:int>,writing_mode:string,position:string,source:string,lines:array<{LINE}>>"
NORMALIZATION = "struct<rule:string,field:string,block_index:int,line_index:int,annotation_index:int,before:string,after:string>"
DOCUMENT = f"struct<prompt_version:string,provider:string,model:string,language:string,unreadable:boolean,blocks:array<{BLOCK}>,normalizations:array<{NORMALIZATION}>>"
ISSUE = "struct<code:string,severity:string,stage:string,path:string,message:string,codepoint:string>"
GEOMETRY = "struct<canvas_width:int,canvas_height:int,x:int,y:int,width:int,height:int,image_width:int,image_height:int,forced:boolean,inferred_end:boolean>"
SETTINGS = "struct<ocr_language:string,target_language:string,proper_nouns:array<struct<source:string,translation:string>>>"
TITLE = "struct<index:int,playlist:string,duration_seconds:bigint,chapters:int,angles:int,clips:int,video_tracks:int,audio_tracks:int,pgs_tracks:int,pgs_languages:array<string>>"
#: Schemas of the evidence store, one table each.
TABLES = {
    "projects": f"project_id string, schema_version int, name string, created_at timestamp, updated_at timestamp, origin struct<project_id:string,path:string,cloned_at:timestamp>, settings {SETTINGS}",
    "sources": f"project_id string, id string, kind string, display_name string, path string, fingerprint string, created_at timestamp, main_title_index int, titles array<{TITLE}>",
    "tracks": "project_id string, id string, source_id string, stream_index int, language string, codec string, metadata struct<title_index:int,playlist:string,sup_path:string>",
    "cues": f"project_id string, id string, track_id string, cue_index int, start_ms bigint, end_ms bigint, image_path string, image_sha256 string, geometry {GEOMETRY}",
    "ocr_runs": "project_id string, id string, provider string, model string, prompt_version string, language string, settings string, created_at timestamp",
    "ocr_attempts": f"project_id string, append_seq bigint, id string, cue_id string, run_id string, attempt_number int, status string, raw_response string, candidate {DOCUMENT}, issues array<{ISSUE}>, elapsed_ms bigint, created_at timestamp",
    "cue_revisions": f"project_id string, append_seq bigint, id string, cue_id string, author string, start_ms bigint, end_ms bigint, subtitle {DOCUMENT}, created_at timestamp",
    "review_decisions": "project_id string, append_seq bigint, id string, cue_id string, revision_id string, status string, note string, created_at timestamp",
    "job_events": "project_id string, append_seq bigint, job_id string, kind string, status string, phase string, current int, total int, cue_id string, cue_index int, completed_cue_ids array<string>, request string, error string, result string, at timestamp",
    "exports": "project_id string, id string, format string, path string, settings string, created_at timestamp",
    "tombstones": "project_id string, append_seq bigint, cue_id string, revision_id string, at timestamp",
}
#: Closed sets of names.
ENUMS = {
    "author": ("ocr", "human", "translation"), "ocr_status": ("pending", "running", "succeeded", "failed"), "review_status": ("unreviewed", "needs_review", "approved"),
    "job_kind": ("ocr", "translation", "pgs_extraction"), "job_status": ("queued", "running", "paused", "interrupted", "completed", "failed", "canceled"),
    "writing_mode": ("horizontal_tb", "vertical_rl"), "block_source": ("detected", "whole_cue", "manual"), "ruby_position": ("over", "under"), "severity": ("info", "warning"),
}
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DIAGNOSTICS = "id string, session_id string, sequence bigint, created_at_ms bigint, level string, source string, category string, operation string, phase string, message string, correlation_id string, duration_ms bigint, details string"


def read_evidence(spark: SparkSession, folder: str, tables: tuple[str, ...] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The tables of an evidence store; predicates and columns are pushed into the scans, partitions by project pruned."""
    return {t: spark.read.schema(TABLES[t]).parquet(f"{folder}/{t}") for t in tables}


def decode_project_metadata(df: DataFrame, *, document: str = "document") -> DataFrame:
    """JSON project documents as columns; missing settings are Japanese to Korean without mappings."""
    meta = F.from_json(document, f"struct<id:string,schema_version:int,name:string,settings:{SETTINGS}>")
    defaults = F.struct(F.lit("jpn").alias("ocr_language"), F.lit("kor").alias("target_language"), F.array().cast("array<struct<source:string,translation:string>>").alias("proper_nouns"))
    return df.withColumn("_m", meta).withColumns({"project_id": F.col("_m.id"), "schema_version": F.col("_m.schema_version"), "name": F.col("_m.name"), "settings": F.coalesce("_m.settings", defaults)}).drop("_m")


def decode_typed_documents(df: DataFrame, column: str, schema: str, *, enums: dict[str, str] | None = None, ids: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with ``decoded``, quarantined rows with ``error``): malformed JSON, names outside a closed set ({column: enum}) and bad ids."""
    rows = df.withColumn("decoded", F.from_json(column, schema))
    bad = [F.when(F.try_parse_json(column).isNull(), F.lit("invalid JSON"))]
    bad += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*ENUMS[e]), F.concat(F.lit(f"invalid {e}: "), F.col(c))) for c, e in (enums or {}).items()]
    bad += [F.when(~F.coalesce(F.col(c).rlike(UUID), F.lit(False)), F.lit(f"invalid id in {c}")) for c in ids]
    rows = rows.withColumn("error", F.coalesce(*bad))
    return rows.where("error is null").drop("error"), rows.where("error is not null").drop("decoded")


def read_cue_images(spark: SparkSession, folder: str, cues: DataFrame, *, image_path: str = "image_path") -> DataFrame:
    """Cues with the bytes of their image; absolute paths and such that leave the folder have an error."""
    path = F.col(image_path)
    bad = path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | ~path.startswith("assets/cues/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    files = files.select(F.regexp_extract("path", "(assets/cues/.*)$", 1).alias("_relative"), F.col("content").alias("image"))
    return cues.withColumn("_bad", bad).join(files, (path == F.col("_relative")) & ~F.col("_bad"), "left").withColumn("error", F.when(F.col("_bad"), "image path leaves the project").when(F.col("image").isNull(), "image not found")).drop("_bad", "_relative")


#: Fixed value: the form in which the listing tool prints a title.
_TITLE_LINE = r"index:\s*(\d+)\s+duration:\s*(\d+):(\d+):(\d+)\s+chapters:\s*(\d+)\s+angles:\s*(\d+)\s+clips:\s*(\d+)\s+\(playlist:\s*(\d+)\.mpls\)\s+V:(\d+)\s+A:(\d+)\s+PG:(\d+)"


def parse_title_listings(listings: DataFrame, *, file: str = "path", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(titles, one row a file with main_title_index and error) of text disc listings.

    A line ``PG : ...`` gives its languages to the last title above it.
    """
    lines = listings.select(F.col(file).alias("path"), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    part = lambda i: F.regexp_extract("line", _TITLE_LINE, i).try_cast("bigint")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("title", F.when(F.col("line").rlike(_TITLE_LINE), part(1))).withColumn("title_no", F.count("title").over(w))
    languages = F.when(F.ltrim(F.col("line")).startswith("PG :"), F.filter(F.split(F.regexp_replace("line", r"^\s*PG :", ""), r"\s+"), lambda x: x != ""))
    said = rows.where("title_no > 0").withColumn("_languages", languages).groupBy("path", "title_no").agg(F.max_by("_languages", F.when(F.col("_languages").isNotNull(), F.col("line_no"))).alias("pgs_languages"))
    titles = rows.where("title is not null").select(
        "path", "title_no", part(1).cast("int").alias("index"), F.lpad(F.regexp_extract("line", _TITLE_LINE, 8), 5, "0").alias("playlist"), (part(2) * 3600 + part(3) * 60 + part(4)).alias("duration_seconds"),
        *[part(i).cast("int").alias(n) for i, n in ((5, "chapters"), (6, "angles"), (7, "clips"), (9, "video_tracks"), (10, "audio_tracks"), (11, "pgs_tracks"))],
    )
    titles = titles.join(said, ["path", "title_no"], "left").drop("title_no").withColumn("pgs_languages", F.coalesce("pgs_languages", F.array().cast("array<string>")))
    named = F.regexp_extract(trim_unicode("line"), r"^Main title:(.*)$", 1)
    main = lines.where(trim_unicode("line").startswith("Main title:")).groupBy("path").agg(F.min_by(named, "line_no").alias("_main"))
    files = lines.select("path").distinct().join(main, "path", "left").withColumn("main_title_index", trim_unicode("_main").try_cast("int"))
    listed = titles.groupBy("path").agg(F.collect_set("index").alias("_titles"))
    files = files.join(listed, "path", "left")
    error = F.when(F.col("_main").isNull(), "main title is missing").when(F.col("main_title_index").isNull(), "main title is not a number").when(F.col("_titles").isNull(), "no playable titles were reported").when(~F.array_contains("_titles", F.col("main_title_index")), "main title was not listed")
    return titles, files.select("path", "main_title_index", error.alias("error"))


#: Fixed value: names of log segments.
SESSION_FILE = r"^session-(.+)-\d+\.jsonl$"


def read_diagnostics(spark: SparkSession, folder: str, stream: bool = False, *, pattern: str = "session-*.jsonl") -> DataFrame:
    """Entries of ``session-<id>-NNN.jsonl`` files; blank and broken lines are left out, the session id comes from the file name, of other names from the entry.

    As a stream it follows segments that grow: an entry comes once, when its line is whole.
    """
    if stream:
        spark.dataSource.register(GrowingLines)
        lines = spark.readStream.format("growing_lines").option("pattern", pattern).load(folder)
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        rows = lines.where(F.trim("value") != "").select("file", F.from_json("value", DIAGNOSTICS + ", _corrupt_record string", options).alias("entry")).select("file", "entry.*")
    else:
        reader = spark.read.schema(DIAGNOSTICS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        rows = reader.json(folder).withColumn("file", F.col("_metadata.file_name"))
    named = F.nullif(F.regexp_extract("file", SESSION_FILE, 1), F.lit(""))
    return rows.where("_corrupt_record is null").withColumn("session_id", F.coalesce(named, "session_id")).drop("_corrupt_record", "file")
