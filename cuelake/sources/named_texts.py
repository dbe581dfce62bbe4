"""A sink for files with names of their own, put together from rows.

Spark's text writer names files itself and ends each row with a separator. This one takes rows of
(name, value): values of one name that follow each other in a task are the file of that name, byte
for byte. Tasks write under names of their attempt; the driver moves whole files into place when
all tasks are done, and deletes what a failed job has left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cuelake.sources.files import open_path


@dataclass
class Written(WriterCommitMessage):
    #: (name, where it waits) of each file of a task
    files: list[tuple[str, str]] = field(default_factory=list)


class TextWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = open_path(self.folder)
        waiting = f"{inner}/_waiting-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(waiting, recursive=True)
        out, now, files = None, None, []
        try:
            for batch in iterator:
                for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if name != now or out is None:
                        if not name or "/" in name or name.startswith((".", "_")):
                            raise ValueError(f"not a file name: {name!r}")
                        if out is not None:
                            out.close()
                        now = name
                        files.append((name, f"{waiting}/{len(files)}"))
                        out = system.open_output_stream(files[-1][1])
                    out.write(value.encode() if isinstance(value, str) else value or b"")
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = open_path(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one name have to follow each other in one task")
        for name, waits in files:
            system.move(waits, f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = open_path(self.folder)
        system.delete_dir_contents(f"{inner}/_waiting-{self.job}", missing_dir_ok=True)
        if system.get_file_info(f"{inner}/_waiting-{self.job}").is_file is False:
            system.delete_dir(f"{inner}/_waiting-{self.job}")


class NamedTexts(DataSource):
    """Format ``named_texts``: writes rows of (name, value), text in UTF-8 or binary, as files in the folder ``path``; files of these names are replaced, others stay."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["path"])


def write_named(rows: DataFrame, path: str, *, name: str = "name", place: str = "place", value: str = "value") -> None:
    """One file for each ``name``, its values by ``place``. A file is written by one task, row by row, however long it gets."""
    rows.sparkSession.dataSource.register(NamedTexts)
    dealt = rows.select(F.col(name).cast("string").alias("name"), F.col(place).alias("place"), F.col(value).alias("value")).repartition("name").sortWithinPartitions("name", "place")
    dealt.select("name", "value").write.format("named_texts").mode("append").save(path)
