"""Streams give what the batch gives."""

import json
import struct

from pyspark.sql import functions as F

from cuelake.operators import diagnostics, export
from cuelake.operators.evidence import effective_revision
from cuelake.sources import readers, sinks
from cuelake.streaming import feeds


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_effective_and_progress(spark, tmp_path):
    rows = [{"cue_id": i % 3, "append_seq": i, "author": f"a{i}"} for i in range(9)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text("\n".join(map(json.dumps, rows[5:])))
    (tmp_path / "r/2.json").write_text("\n".join(map(json.dumps, rows[:5])))
    schema = "cue_id long, append_seq long, author string"
    live = drain(feeds.stream_effective(spark.readStream.schema(schema).json(str(tmp_path / "r"))), "eff", "complete")
    batch = effective_revision(spark.read.schema(schema).json(str(tmp_path / "r")))
    assert sorted((r.cue_id, r.author) for r in live.collect()) == sorted((r.cue_id, r.author) for r in batch.collect())
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.json").write_text("\n".join(json.dumps({"job_id": "j", "append_seq": i, "phase": p, "current": i}) for i, p in ((2, "b"), (1, "a"))))
    assert [(r.phase, r.current) for r in drain(feeds.stream_progress(feeds.read_progress(spark, str(tmp_path / "p"))), "prog", "complete").collect()] == [("b", 2)]


def test_log_tail_and_session_files(spark, tmp_path):
    good = {"id": "1", "sequence": 1, "message": "m", "details": '{"password":"x"}'}
    (tmp_path / "session-abc-001.jsonl").write_text(json.dumps(good) + "\n\n" + '{"id": "2", "seq')
    batch = diagnostics.redact_details(readers.read_diagnostics(spark, str(tmp_path))).collect()
    live = drain(feeds.stream_log_tail(spark, str(tmp_path)), "tail", "append").collect()
    assert [(r.session_id, r.details) for r in batch] == [("abc", '{"password":"[REDACTED]"}')] == [(r.session_id, r.details) for r in live]


def test_cues_from_arriving_files(spark, tmp_path):
    from test_ingest import ONE

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sup").write_bytes(ONE)
    out = []
    q = feeds.stream_cues(spark, str(tmp_path / "in"), str(tmp_path / "c"), lambda cues, failed, n: out.append((cues.count(), failed.count())))
    q.awaitTermination(120)
    assert out == [(1, 0)]


def test_sinks(spark, tmp_path):
    entries = spark.createDataFrame([(1, 2, "2\nb\n"), (1, 1, "1\na\n"), (2, 1, "1\nc\n")], "track_id long, seq long, entry string")
    sinks.write_srt(entries, str(tmp_path / "srt"))
    files = list((tmp_path / "srt/track_id=1").glob("*.txt"))
    assert len(files) == 1 and files[0].read_text() == "1\na\n\n2\nb\n\n"
    log = spark.createDataFrame([("s", 1), ("t", 2)], "session_id string, sequence long")
    sinks.write_session(log, "s", str(tmp_path / "log"))
    assert [json.loads(r.value)["sequence"] for r in spark.read.text(str(tmp_path / "log")).collect()] == [1]
    sinks.write_survey(log.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "survey"))
    assert spark.read.json(str(tmp_path / "survey")).first().n == 2
    store = spark.createDataFrame([("p", "i", "t", 1)], "project_id string, id string, source_id string, stream_index int")
    sinks.append_evidence(store, str(tmp_path / "e/tracks"))
    assert readers.read_evidence(spark, str(tmp_path / "e"), ("tracks",))["tracks"].first().source_id == "t"


def test_canonical_documents_in_files(spark, tmp_path):
    """One JSON file a track, cues by start, end and index."""
    cues = spark.createDataFrame([("t1", 20, 30, 2), ("t1", 0, 10, 1), ("t2", 5, 6, 1)], "track_id string, start_ms long, end_ms long, cue_index int")
    sinks.write_canonical_json(export.canonical_documents(cues), str(tmp_path / "json"))
    found = {r.track_id: json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()}
    assert set(found) == {"t1", "t2"} and [c["cue_index"] for c in found["t1"]["cues"]] == [1, 2]
    assert len(list((tmp_path / "json/track_id=t1").glob("*.txt"))) == 1


def test_segments_and_sessions_from_files(spark, tmp_path):
    """Streams and log sessions are read from files as batches; broken ones are told or left out."""
    (tmp_path / "sup").mkdir()
    whole = struct.pack(">2sIIBH", b"PG", 90, 0, 0x80, 0)
    (tmp_path / "sup/a.sup").write_bytes(whole * 2)
    (tmp_path / "sup/b.sup").write_bytes(whole + b"PX")
    rows = readers.read_sup_segments(spark, str(tmp_path / "sup/*.sup")).collect()
    assert sorted((r.path[-5:], r.seg_no, r.pts, r.kind, r.error) for r in rows) == [("a.sup", 1, 90, 128, None), ("a.sup", 2, 90, 128, None), ("b.sup", 1, 90, 128, None), ("b.sup", 2, 0, -1, "truncated segment header")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/session-s1-001.jsonl").write_text('{"sequence":1,"level":"info"}\n\n{broken\n{"sequence":2,"level":"error"}\n')
    assert sorted((r.session_id, r.sequence, r.level) for r in readers.read_diagnostics(spark, str(tmp_path / "log")).collect()) == [("s1", 1, "info"), ("s1", 2, "error")]
