"""Presentation-graphics streams cut into byte ranges, so that one stream of any size is read by many tasks.

Where a segment starts is only known from the segment before it: two letters open a header, but a
payload may hold them too. So the border between two ranges is proved, not guessed. Each range
follows the chain of lengths from every place near its start where a segment could begin, and notes
where that chain leaves the range and after how many segments. From the start of the file these
notes give the true entry of range after range; they are a few numbers a range. Then each range is
read from its true entry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.files import read_range

#: The length of a header, and of the longest segment.
HEADER, LONGEST = 13, 13 + 0xFFFF
SEGMENT = "path string, seg_no long, pts long, kind int, payload binary, error string"
BATCH_BYTES = 8 << 20
#: So many notes of ranges go in a batch, and those of one range more.
MOST_NOTES = 10_000


def split_segments(data: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(pts, kind, payload) of each segment that begins before ``stop``; ValueError if one is broken off."""
    stop = len(data) if stop is None else stop
    while at < stop:
        if at + HEADER > len(data):
            raise ValueError("truncated segment header")
        mark, pts, _, kind, n = struct.unpack_from(">2sIIBH", data, at)
        if mark != b"PG":
            raise ValueError("invalid segment signature")
        if at + HEADER + n > len(data):
            raise ValueError("truncated segment payload")
        yield pts, kind, data[at + HEADER : at + HEADER + n]
        at += HEADER + n


def chains(data: bytes, start: int, stop: int, size: int) -> list[tuple[int, int | None, int]]:
    """(entry, exit, segments) for each place of a range where a segment of the stream could begin first.

    ``data`` are the file's bytes from ``start`` on, a header further than ``stop``; the exit is the
    first place at or after ``stop`` that the chain reaches, None if the chain breaks. Chains that
    meet go on as one, so that each place is looked at once.
    """
    left: dict[int, tuple[int, int]] = {}  # of each place reached: the number of its chain and of segments before it
    ends: list[tuple[int | None, int]] = []  # of each chain: exit and segments
    out = []
    near = data[: min(start + LONGEST, stop) - start + 1]
    entry = near.find(b"PG")
    while entry >= 0:
        at, passed, own = start + entry, 0, []
        end: tuple[int | None, int] | None = None
        while at < stop:
            if at in left:
                chain, before = left[at]
                end = ends[chain][0], passed + ends[chain][1] - before
                break
            own.append(at)
            i = at - start
            if data[i : i + 2] != b"PG" or at + HEADER > size or (after := at + HEADER + int.from_bytes(data[i + 11 : i + 13], "big")) > size:
                end = None, passed
                break
            at, passed = after, passed + 1
        ends.append(end or (at, passed))
        left.update((place, (len(ends) - 1, n)) for n, place in enumerate(own))
        out.append((start + entry, *ends[-1]))
        entry = near.find(b"PG", entry + 1)
    return out


def true_entries(notes: list[tuple[int, int, list[tuple[int, int | None, int]]]]) -> list[tuple[int, int, int, int]]:
    """(start, stop, entry, number of the first segment) of the ranges that are to be read, from each one's notes in file order."""
    out, entry, number = [], 0, 1
    for start, stop, found in notes:
        if entry >= stop:
            continue  # a segment reaches over the whole range
        out.append((start, stop, entry, number))
        after = {at: (leaves, segments) for at, leaves, segments in found}.get(entry)
        if after is None or after[0] is None:
            break  # the chain breaks in this range, which is read up to there
        entry, number = after[0], number + after[1]
    return out


def segments_in_files(files: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, seg_no, pts, kind, payload, error) of the streams in ``files`` (path, length).

    A stream up to ``range_bytes`` is read at once, a longer one in ranges. A broken stream has its
    sound segments and then a row with the error. Empty files have no rows.
    """
    if range_bytes < 1:
        raise ValueError("a range needs a byte")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    listed = files.select("path", F.col("length").cast("long").alias("length")).where("length > 0")
    ranges = listed.where(F.col("length") > range_bytes).select("path", "length", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + range_bytes, "length"))

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                found = chains(read_range(r["path"], r["start"], min(r["stop"] + HEADER, r["length"])), r["start"], r["stop"], r["length"])
                rows.append(r | {"found": [dict(zip(("at", "leaves", "segments"), f, strict=True)) for f in found]})
                held += len(found)
                if held > MOST_NOTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("found", pa.list_(pa.struct([("at", pa.int64()), ("leaves", pa.int64()), ("segments", pa.int64())])))])
    noted = ranges.repartition(tasks).mapInArrow(note, "path string, length long, start long, stop long, found array<struct<at:long,leaves:long,segments:long>>")

    def enter(key: tuple, rows: pa.Table) -> pa.Table:
        notes = sorted((r["start"], r["stop"], [(f["at"], f["leaves"], f["segments"]) for f in r["found"]]) for r in rows.select(["start", "stop", "found"]).to_pylist())
        out = true_entries(notes)
        length = rows.column("length")[0].as_py()
        return pa.table({"path": [key[0].as_py()] * len(out), "length": pa.array([length] * len(out), pa.int64()), **{n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("start", "stop", "entry", "first"))}})

    plan = "path string, length long, start long, stop long, entry long, first long"
    entered = noted.groupBy("path").applyInArrow(enter, plan).select("path", "length", "stop", "entry", "first")
    whole = listed.where(F.col("length") <= range_bytes).select("path", "length", F.col("length").alias("stop"), F.lit(0).cast("long").alias("entry"), F.lit(1).cast("long").alias("first"))

    def parts(rows: list[dict]) -> Iterator[tuple[str, int, Iterator[tuple[int, int, bytes]]]]:
        for r in rows:
            data = read_range(r["path"], r["entry"], min(r["stop"] + LONGEST, r["length"]))
            yield r["path"], r["first"], split_segments(data, 0, r["stop"] - r["entry"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from as_batches(parts(batch.to_pylist()))

    return whole.unionByName(entered).repartition(tasks).mapInArrow(read, SEGMENT)


def as_batches(parts: Iterator[tuple[str, int, Iterator[tuple[int, int, bytes]]]]) -> Iterator[pa.RecordBatch]:
    """Rows of the segments of (path, number of the first, segments), a few megabytes a batch, however short the parts are."""
    schema = pa.schema([("path", pa.string()), ("seg_no", pa.int64()), ("pts", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
    rows, held = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for path, number, segments in parts:
        try:
            for pts, kind, payload in segments:
                rows.append((path, number, pts, kind, payload, None))
                number, held = number + 1, held + len(payload) + 64
                if held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        except ValueError as e:
            rows.append((path, number, 0, -1, b"", str(e)))
            held += 64
    if rows:
        yield batch()


def read_sup_segments(spark: SparkSession, glob: str, range_bytes: int = 32 << 20) -> DataFrame:
    """``segments_in_files`` of the files that ``glob`` names; Spark lists them and reads no content itself."""
    return segments_in_files(spark.read.format("binaryFile").load(glob).select("path", "length"), range_bytes)


def segments_of(files: DataFrame) -> DataFrame:
    """``read_sup_segments`` of (path, content), for streams that are rows already; a row is a task's unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)
            yield from as_batches((path, 1, split_segments(content.as_py() or b"")) for path, content in streams)

    return files.select("path", "content").mapInArrow(run, SEGMENT)
