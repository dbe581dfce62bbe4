"""Documents larger than a row, and files with names of their own."""

import json

import pytest
from pyspark.sql import functions as F

from cuelake.operators import evidence, export
from cuelake.sources import named_texts, sinks


def test_same_bytes_as_the_small_form(spark, tmp_path):
    rows = [(t, s * 100 % 700, s, s, f"text {s} \\" + '"é') for t in ("a", "b") for s in range(40)] + [("c", None, 1, 0, None), ("c", 5, None, 1, "x")]
    cues = spark.createDataFrame(rows, "track_id string, start_ms long, end_ms long, cue_index int, text string")
    small = {r.track_id: r.document for r in export.canonical_documents(cues, more=("text",)).collect()}
    sinks.write_documents(export.canonical_lines(cues, more=("text",), tasks=5), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"{t}.json": d for t, d in small.items()}
    assert len(json.loads(small["a"])["cues"]) == 40


def test_a_long_track(spark, tmp_path):
    """300,000 cues of one track: one sound document, its rows dealt to many tasks."""
    n = 300_000
    cues = spark.range(n).select(F.lit("long").alias("track_id"), (F.col("id") * 7 % n).alias("start_ms"), (F.col("id") * 7 % n + 5).alias("end_ms"), F.col("id").cast("int").alias("cue_index"))
    sinks.write_documents(export.canonical_lines(cues, tasks=16), str(tmp_path / "out"))
    found = json.loads((tmp_path / "out/long.json").read_text())
    assert [c["start_ms"] for c in found["cues"]] == list(range(n)) and found["version"] == 2


def test_projects_with_several_lists(spark, tmp_path):
    projects = spark.createDataFrame([("p", "one"), ("q", "none")], "project_id string, name string")
    tracks = spark.createDataFrame([("p", "t2"), ("p", "t1"), ("x", "t3")], "project_id string, id string")
    jobs = spark.createDataFrame([("p", 3)], "project_id string, job int")
    lines = export.document_lines(projects, {"tracks": tracks, "jobs": jobs}, owner="project_id", order={"tracks": ("id",), "jobs": ("job",)}, head=("project_id", "name"), tasks=3)
    sinks.write_documents(lines, str(tmp_path / "out"), owner="project_id")
    nested = evidence.project_document(projects, {"tracks": (tracks, ("id",)), "jobs": (jobs, ("job",))})
    want = {f"{r.project_id}.json": r.document for r in nested.select("project_id", F.to_json(F.struct("project_id", "name", "tracks", "jobs")).alias("document")).collect()}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == want


def test_files_are_whole_or_absent(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", 2, "two"), ("a.txt", 1, "one\n"), ("b.txt", 1, None)], "name string, place int, value string")
    named_texts.write_named(rows, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "one\ntwo", "b.txt": ""}
    named_texts.write_named(rows.where("name = 'a.txt' and place = 1"), str(tmp_path / "out"))  # replaced, the other stays
    assert (tmp_path / "out/a.txt").read_text() == "one\n" and (tmp_path / "out/b.txt").exists()
    with pytest.raises(Exception, match="not a file name"):
        named_texts.write_named(rows.withColumn("name", F.lit("../up")), str(tmp_path / "bad"))
    assert list((tmp_path / "bad").iterdir()) == [] and not (tmp_path / "up").exists()
    named_texts.write_named(rows.limit(0), str(tmp_path / "none"))
