"""A streaming source of lines in files that grow.

Spark's own file source takes a file once, when it first sees it. Log segments are appended to for
as long as their session runs, and their last line may be half written. This source keeps a byte
offset for each file. A trigger takes each file up to its last line end; what follows waits. Bytes
that were taken never change, so a restarted query reads a batch's ranges again exactly.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cuelake.sources.files import open_path

BLOCK = 1 << 20
LINES = pa.schema([("file", pa.string()), ("position", pa.int64()), ("value", pa.string())])


@dataclass
class LineRange(InputPartition):
    """The lines of a file that begin in [start, stop); ``begin`` is where the batch begins, at a line's start."""

    file: str
    begin: int
    start: int
    stop: int


def last_line_end(f, size: int) -> int:
    """The place after the last line break within the first ``size`` bytes, 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - BLOCK)
        f.seek(start)
        found = f.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def lines_of(f, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """(position, line without its break) of a range; the last one may end behind it."""
    at = part.start
    if at > part.begin:  # the line that is open here belongs to the range before
        f.seek(at - 1)
        at -= 1
        while True:
            block = f.read(BLOCK)
            found = block.find(b"\n")
            if not block or found >= 0:
                at += found + 1 if block else 0
                break
            at += len(block)
    f.seek(at)
    held = b""
    while at < part.stop:
        block = f.read(BLOCK)
        if not block:
            return  # the batch ends at a line break, so that nothing is held here
        *whole, held = (held + block).split(b"\n")
        for line in whole:
            if at >= part.stop:
                return
            yield at, line
            at += len(line) + 1


class LineReader:
    def __init__(self, options):
        self.folder, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")
        self.range_bytes = int(options.get("rangeBytes", 64 << 20))
        self.strict = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.seen: dict[str, tuple[int, int]] = {}

    def ends(self) -> dict[str, int]:
        """Of each file that has whole lines, where they end. Only files that changed size are looked into, from their end."""
        system, inner = open_path(self.folder)
        out = {}
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch.fnmatchcase(info.base_name, self.pattern):
                continue
            if self.seen.get(info.base_name, (-1, 0))[0] != info.size:
                with system.open_input_file(info.path) as f:
                    self.seen[info.base_name] = info.size, last_line_end(f, info.size)
            if self.seen[info.base_name][1]:
                out[info.base_name] = self.seen[info.base_name][1]
        return out

    def ranges(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            begin = 0 if stop < begin else begin  # shorter than before: written anew
            out += [LineRange(file, begin, a, min(a + self.range_bytes, stop)) for a in range(begin, stop, self.range_bytes)]
        return out

    def read(self, part: LineRange) -> Iterator[pa.RecordBatch]:
        system, inner = open_path(f"{self.folder}/{part.file}")
        try:
            f = system.open_input_file(inner)
        except FileNotFoundError:
            if self.strict:
                raise
            return
        with f:
            rows, held = [], 0
            for at, line in lines_of(f, part):
                rows.append((part.file, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                held += len(line) + 40
                if held > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), LINES, strict=True)], schema=LINES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), LINES, strict=True)], schema=LINES)


class LineBatch(LineReader, DataSourceReader):
    def partitions(self) -> list[LineRange]:
        return self.ranges({}, self.ends())


class LineStream(LineReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return self.ranges(start, end)


class GrowingLines(DataSource):
    """Format ``growing_lines``: (file, position, value) of the whole lines of the files in the folder ``path``.

    Options: ``pattern`` of file names (``*``); ``rangeBytes`` of a task (64 MB); ``failOnDataLoss``
    (true): a file that is gone before its batch was read is an error, else it has no rows. A file
    that got shorter is read from its start. The offset has a number for each file in the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, position bigint, value string"

    def reader(self, schema) -> LineBatch:
        return LineBatch(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)
