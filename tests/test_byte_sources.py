"""Streams read in byte ranges, and log segments that grow."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from cuelake.sources import readers, segments, tail
from cuelake.streaming import feeds


def segment(kind, payload, pts=0):
    return struct.pack(">2sIIBH", b"PG", pts, 0, kind, len(payload)) + payload


def decoys():
    """Payloads that hold whole segments, headers with wild lengths and bare letters."""
    inner = segment(0x15, b"x" * 5, 7)
    return b"".join([segment(0x16, inner + inner), segment(0x14, b"PG" * 9), segment(0x15, b"PG" + b"\xff" * 20), segment(0x80, b""), segment(0x15, inner[:9]), segment(0x15, b"P", 3), segment(0x80, b"G")])


def whole(data):
    out = []
    try:
        for s in segments.split_segments(data):
            out.append(s)
    except ValueError as e:
        out.append(str(e))
    return out


def in_ranges(data, size):
    notes = []
    for a in range(0, len(data), size):
        b = min(a + size, len(data))
        notes.append((a, b, segments.chains(data[a : min(b + segments.HEADER, len(data))], a, b, len(data))))
    out, numbers = [], []
    for _, stop, entry, first in segments.true_entries(notes):
        numbers.append(first == len(out) + 1)
        out += whole_from(data[entry : min(stop + segments.LONGEST, len(data))], stop - entry)
    return out, all(numbers)


def whole_from(data, stop):
    out = []
    try:
        for s in segments.split_segments(data, 0, stop):
            out.append(s)
    except ValueError as e:
        out.append(str(e))
    return out


BROKEN = {"sound": lambda d: d, "cut in a header": lambda d: d[:-6], "cut in a payload": lambda d: d + segment(1, b"abcdef")[:-2], "bad mark": lambda d: d[:40] + d + b"PXxxxxxxxxxxxxxxx", "one byte": lambda d: d + b"P", "empty": lambda d: b""}


@pytest.mark.parametrize("kind", BROKEN)
def test_any_range_size_gives_the_same_segments(kind):
    data = BROKEN[kind](decoys())
    for size in range(1, len(data) + 2):
        assert in_ranges(data, size) == (whole(data), True), size


def test_random_streams_in_ranges():
    rng = random.Random(6)
    for _ in range(60):
        data = b"".join(segment(rng.randrange(256), bytes(rng.choice(b"PG\x00\x05\x0d") for _ in range(rng.choice([0, 1, 13, 60, 300])))) for _ in range(rng.randint(1, 25)))
        data = data[: len(data) - rng.choice([0, 0, 1, 5, 14])]
        for size in (1, 2, 13, rng.randint(3, 400)):
            assert in_ranges(data, size) == (whole(data), True)


def test_files_in_ranges(spark, tmp_path):
    streams = {"a b.sup": decoys() * 9, "cut%20.sup": decoys() * 3 + b"PG\x00", "none.sup": b"", "one.sup": segment(0x80, b"", 9)}
    for name, data in streams.items():
        (tmp_path / name).write_bytes(data)

    def found(size):
        rows = segments.read_sup_segments(spark, str(tmp_path / "*.sup"), size).withColumn("path", F.regexp_extract("path", "[^/]*$", 0)).collect()
        return sorted((r.path, r.seg_no, r.pts, r.kind, bytes(r.payload), r.error) for r in rows)

    want = []
    for name, data in streams.items():
        for n, s in enumerate(whole(data), 1):
            want.append((name, n, 0, -1, b"", s) if isinstance(s, str) else (name, n, *s, None))
    for size in (1 << 20, 64, 31):
        assert found(size) == sorted(want)


def test_long_stream(spark, tmp_path):
    """A sparse file of 96 MB in ranges of 4 MB: each segment once, numbered through."""
    with open(tmp_path / "long.sup", "wb") as f:
        for n in range(1500):
            f.write(struct.pack(">2sIIBH", b"PG", n, 0, 0x15, 65000))
            f.seek(65000, 1)
        f.write(segment(0x80, b""))
    rows = segments.read_sup_segments(spark, str(tmp_path / "long.sup"), 4 << 20)
    got = rows.agg(F.count("*").alias("n"), F.count_distinct("seg_no").alias("d"), F.max("seg_no").alias("m"), F.count_if((F.col("pts") != F.col("seg_no") - 1) & (F.col("kind") == 0x15)).alias("off"), F.count("error").alias("e"), F.sum(F.octet_length("payload")).alias("b")).first()
    assert tuple(got) == (1501, 1501, 1501, 0, 0, 1500 * 65000)


def entry(n, **more):
    return json.dumps({"id": str(n), "sequence": n, "message": f"m{n}", "details": {"password": "x"}, **more})


def run(spark, folder, checkpoint, out):
    q = feeds.stream_log_tail(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.session_id, r.sequence) for r in spark.read.parquet(str(out)).collect())


def test_segments_that_grow(spark, tmp_path):
    """Appended and half-written lines come once each, over restarts from the checkpoint; other files are left alone."""
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "session-a-001.jsonl", logs / "session-b-001.jsonl"
    (logs / "other.txt").write_text("not a log\n")
    second = entry(2, message="é" * 40)
    a.write_bytes((entry(1) + "\n\n{broken\n" + second).encode()[:-15])
    state, out = tmp_path / "state", tmp_path / "out"
    assert run(spark, logs, state, out) == [("a", 1)]
    with a.open("ab") as f:
        f.write(second.encode()[-15:] + b"\r\n" + entry(3).encode())
    assert run(spark, logs, state, out) == [("a", 1), ("a", 2)]
    with a.open("ab") as f:
        f.write(b"\n" + entry(4).encode() + b"\n")
    b.write_text(entry(1) + "\n")
    (logs / "session-a-002.jsonl").write_text(entry(5) + "\n")
    want = [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert run(spark, logs, state, out) == want == run(spark, logs, state, out)
    assert {r.details for r in spark.read.parquet(str(out)).collect()} == {'{"password":"[REDACTED]"}'}


def test_a_running_query_follows(spark, tmp_path):
    """One query that stays up sees what is appended between its triggers."""
    log = tmp_path / "session-s-001.jsonl"
    log.write_text(entry(1) + "\n")
    q = feeds.stream_log_tail(spark, str(tmp_path)).writeStream.format("memory").queryName("follows").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        with log.open("a") as f:
            f.write(entry(2) + "\n" + entry(3)[:10])
        q.processAllAvailable()
        with log.open("a") as f:
            f.write(entry(3)[10:] + "\n")
        q.processAllAvailable()
        assert [r.sequence for r in spark.table("follows").orderBy("sequence").collect()] == [1, 2, 3]
    finally:
        q.stop()


def test_batch_of_lines_and_ranges(spark, tmp_path):
    """However the bytes are cut, each line is read once, where it begins."""
    data = b"".join(b"x" * (i * 7 % 23) + b"\n" for i in range(40)) + b"half"
    (tmp_path / "f.log").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.decode()))
        at += len(line) + 1
    for size in range(1, 60):
        reader = tail.LineReader({"path": str(tmp_path), "rangeBytes": str(size)})
        rows = [(p, v) for part in reader.ranges({}, reader.ends()) for b in reader.read(part) for p, v in zip(b["position"].to_pylist(), b["value"].to_pylist(), strict=True)]
        assert rows == want, size
    spark.dataSource.register(tail.GrowingLines)
    assert spark.read.format("growing_lines").option("rangeBytes", "50").load(str(tmp_path)).count() == 40


def test_files_that_shrink_or_go(tmp_path):
    f = tmp_path / "f"
    f.write_bytes(b"one\ntwo\n")
    reader = tail.LineReader({"path": str(tmp_path)})
    before = reader.ends()
    f.write_bytes(b"new\n")
    parts = reader.ranges(before, reader.ends())
    assert [v for p in parts for b in reader.read(p) for v in b["value"].to_pylist()] == ["new"]
    f.unlink()
    assert reader.ends() == {}
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert list(tail.LineReader({"path": str(tmp_path), "failOnDataLoss": "false"}).read(parts[0])) == []


def test_paths_of_stores():
    from pyarrow import fs

    from cuelake.sources.files import open_path

    for path in ("file:/a/b c", "file:///a/b c", "/a/b c"):
        system, inner = open_path(path)
        assert isinstance(system, fs.LocalFileSystem) and inner == "/a/b c"
    assert readers.SESSION_FILE


def test_short_ranges_share_a_batch():
    from cuelake.sources import segments

    sound = lambda n: iter([(n, 22, b"x"), (n + 1, 22, b"y")])
    rows = [b.to_pylist() for b in segments.as_batches([("a", 1, sound(1)), ("b", 1, segments.split_segments(b"PG", 0)), ("c", 5, sound(7))])]
    assert len(rows) == 1
    assert [(r["path"], r["seg_no"], r["pts"], r["error"]) for r in rows[0]] == [("a", 1, 1, None), ("a", 2, 2, None), ("b", 1, 0, "truncated segment header"), ("c", 5, 7, None), ("c", 6, 8, None)]
