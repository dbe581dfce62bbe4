"""Hand-built streams of segments."""

import struct

import pytest

from cuelake.operators import ingest
from cuelake.sources import readers


def segment(kind, payload, pts=0):
    return struct.pack(">2sIIBH", b"PG", pts, 0, kind, len(payload)) + payload


def presentation(objects, state=0x80, pts=0, canvas=(1920, 1080)):
    refs = b"".join(struct.pack(">HBBHH", n, 0, 0, x, y) for n, x, y in objects)
    return segment(0x16, struct.pack(">HHBHBBBB", *canvas, 0x10, 1, state, 0, 0, len(objects)) + refs, pts)


def palette():
    return segment(0x14, bytes([0, 0, 1, 200, 128, 128, 255, 2, 100, 128, 128, 255]))


def obj(data=b"\x01\x02\x00\x00", number=1, size=(2, 1), split=None):
    head = struct.pack(">HB", number, 0)
    body = (len(data) + 4).to_bytes(3, "big") + struct.pack(">HH", *size)
    if split is None:
        return segment(0x15, head + b"\xc0" + body + data)
    return segment(0x15, head + b"\x80" + body + data[:split]) + segment(0x15, head + b"\x40" + data[split:])


END = segment(0x80, b"")
ONE = presentation([(1, 100, 200)]) + palette() + obj() + END


def cues(spark, **streams):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in streams.items()], "path string, content binary")
    segments = readers.segments_of(files)
    good, failed = ingest.extract_cues(segments.where("error is null"))
    return {r.path: r for r in good.collect()}, {r.path: r.error for r in failed.collect()}, segments


def test_one_cue(spark):
    closing = presentation([], state=0, pts=90000) + segment(0x80, b"", 90000)
    good, failed, _ = cues(spark, a=ONE + closing)
    r = good["a"]
    assert not failed and (r.start_ms, r.end_ms, r.inferred_end) == (0, 1000, False) and (r.x, r.y, r.width, r.height) == (100, 200, 2, 1)
    assert r.image_path == "assets/cues/a/000001.png" and len(r.image_sha256) == 64 and (r.ocr_status, r.review_status) == ("pending", "unreviewed")


def test_streams(spark):
    second = presentation([(1, 5, 5)], pts=180000) + palette() + obj() + END
    good, failed, segments = cues(
        spark, inferred=ONE, split=presentation([(1, 100, 200)]) + palette() + obj(split=2) + END, epochs=ONE + second,
        lost=presentation([(9, 0, 0)]) + palette() + END, overflow=presentation([(1, 0, 0)]) + palette() + obj(b"\x01\x02\x03\x00\x00") + END, empty=presentation([]) + END, cut=ONE[:-5],
    )
    assert good["inferred"].inferred_end and good["inferred"].end_ms == 5000 and good["split"].width == 2
    assert failed["lost"] == "missing object 9" and failed["overflow"] == "run exceeds bitmap dimensions" and failed["empty"] == "no cue in the stream"
    assert {r.path: r.error for r in segments.where("error is not null").collect()} == {"cut": "truncated segment header"}
    assert "epochs" in good


def test_epoch_timing(spark):
    second = presentation([(1, 5, 5)], pts=180000) + palette() + obj() + END
    files = spark.createDataFrame([("e", bytearray(ONE + second))], "path string, content binary")
    good, _ = ingest.extract_cues(readers.segments_of(files))
    assert [(r.cue_index, r.start_ms, r.end_ms) for r in good.orderBy("cue_index").collect()] == [(1, 0, 2000), (2, 2000, 7000)]


def test_runs():
    assert ingest.decode_runs(bytes([1, 0, 0x82, 2, 0, 0, 0, 3, 0, 0]), 3, 2).tolist() == [[1, 2, 2], [0, 0, 0]]
    for data, said in ((b"\x01\x00\x00", "line does not match"), (b"\x00", "truncated control"), (b"\x00\x42", "truncated run"), (b"\x01", "decoded 1 pixels")):
        with pytest.raises(ValueError, match=said):
            ingest.decode_runs(data, 2, 1)


def test_objects_from_fragments(spark):
    rows = [("a", 0, 1, 1, True, 4, bytearray(b"ab")), ("a", 0, 1, 2, False, None, bytearray(b"cd")), ("a", 0, 2, 3, True, 9, bytearray(b"x")), ("a", 0, 3, 4, False, None, bytearray(b"y"))]
    found = ingest.reassemble_objects(spark.createDataFrame(rows, "path string, epoch long, object_id int, seg_no long, first boolean, declared long, data binary"))
    assert {r.object_id: (bytes(r.rle), r.error) for r in found.collect()} == {1: (b"abcd", None), 2: (b"x", "incomplete object"), 3: (b"y", "continuation for unknown object")}


LISTING = """Main title: 2
index: 1 duration: 00:10:00 chapters: 1 angles: 1 clips: 1 (playlist: 00800.mpls) V:1 A:1 PG:0 IG:0
index: 2 duration: 02:01:13 chapters: 12 angles: 1 clips: 1 (playlist: 1.mpls) V:1 A:2 PG:1 IG:0
  PG : jpn
"""


def test_listing(spark):
    rows = spark.createDataFrame([("a", LISTING), ("b", "Main title: x"), ("c", "nothing"), ("d", "Main title: 1")], "path string, value string")
    titles, files = readers.parse_title_listings(rows)
    t = titles.where("index = 2").first()
    assert (t.playlist, t.duration_seconds, t.pgs_languages) == ("00001", 7273, ["jpn"])
    assert {r.path: r.error for r in files.collect()} == {"a": None, "b": "main title is not a number", "c": "main title is missing", "d": "no playable titles were reported"}


def test_image_paths(spark, tmp_path):
    folder = tmp_path / "assets/cues/t"
    folder.mkdir(parents=True)
    (folder / "000001.png").write_bytes(b"x")
    rows = spark.createDataFrame([(1, "assets/cues/t/000001.png"), (2, "/etc/x.png"), (3, "assets/cues/../x.png"), (4, "assets/cues/t/000002.png")], "cue_id long, image_path string")
    found = {r.cue_id: r.error for r in readers.read_cue_images(spark, str(tmp_path), rows).collect()}
    assert found == {1: None, 2: "image path leaves the project", 3: "image path leaves the project", 4: "image not found"}


def test_good_tracks_need_no_list_of_tracks(spark):
    """Tracks without a cue fail, but have no cue that could be taken out."""
    tracks = spark.createDataFrame([(p,) for p in ("a", "b", "c", None)], "path string")
    cues = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", None), (None, None)], "path string, error string")
    good, failed = ingest.quarantine_failed_tracks(tracks, cues)
    assert sorted(str(r.path) for r in good.collect()) == ["None", "a", "a"]
    assert sorted((str(r.path), r.error) for r in failed.collect()) == [("None", "no cue in the stream"), ("b", "x"), ("c", "no cue in the stream")]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
