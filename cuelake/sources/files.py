"""Files read by byte ranges, on executors and on the driver, in any store that Arrow reaches."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/*/", "/", path) if scheme or path.startswith("/") else path
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@?=&%"))


def read_range(path: str, start: int, stop: int) -> bytes:
    """The bytes from ``start`` to ``stop`` or to the end of the file."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        return f.read(max(0, stop - start))
