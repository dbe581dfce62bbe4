"""Words and shingles of Arrow string batches as NumPy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = U64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0]
    return data[first : offsets[-1]], offsets - first


def slices(batch: pa.RecordBatch, column: str, limit: int = 700_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of text each (one long text may exceed it)."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; no word spans two rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = (data != 32) & ((data < 9) | (data > 13))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: its length and its blocks of eight bytes, mixed one after another."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every position
    size = end - start
    h = mix(size.astype(U64) + _MULTIPLIER)
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(short):
        left = size[short] - at
        block = eight[start[short] + at] & (~U64(0) >> (U64(8) * U64(8 - np.minimum(left, 8)).astype(U64)))
        h[short] = mix((h[short] ^ block) * _MULTIPLIER)
        at += 8
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(row, minlength=rows)
    n = len(words) - size + 1
    if n > 0:
        h = words[:n].copy()
        for k in range(1, size):
            h = mix(h + U64(k)) ^ words[k : k + n]
        ok = row[:n] == row[size - 1 :]
        h, at = mix(h[ok]), row[:n][ok]
    else:
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(row, short)
        extra = counts[short].astype(U64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] = mix(extra[has] * _MULTIPLIER + words[first[has] + k])
        h, at = np.concatenate((h, mix(extra ^ U64(0x5851F42D4C957F2D)))), np.concatenate((at, short))
    return h, at


def distinct_by_row(h: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in rising order, and n + 1 offsets."""
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[keep], at[keep]
    return h, np.searchsorted(at, np.arange(rows + 1))
