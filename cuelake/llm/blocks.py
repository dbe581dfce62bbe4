"""Groups of any size dealt to tasks block by block, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF = (1 << 31) - 1


def in_blocks(rows: DataFrame, key: str, member: str, sizes: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` dealt to (key, part): every two blocks of a key, and each with itself, meet in one part.

    ``sizes`` has (k, held) of the keys that matter. A key of one block is one part. The rows of a
    part follow each other by ``member``.
    """
    blocks = sizes.select(F.col("k").alias("_k"), F.ceil(F.col("held") / block_rows).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = rows.join(blocks, F.col(key) == F.col("_k")).withColumn("block", block).withColumn("_p", F.explode(pairs))
    dealt = dealt.withColumn("part", (F.col("_p.i").cast("long") * (1 << 31) + F.col("_p.j"))).drop("_k", "_blocks", "_p")
    return dealt.repartition(key, "part").sortWithinPartitions(key, "part", member)


def whole_parts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole (key, part) groups of ``in_blocks``, and for each row the place after the last of its group."""
    held: list[pa.RecordBatch] = []

    def ends(table: pa.Table) -> np.ndarray:
        k, p = table.column(key).to_numpy(), table.column("part").to_numpy()
        cuts = np.append(np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1, len(k))
        return np.repeat(cuts, np.diff(cuts, prepend=0))

    for batch in batches:
        if not batch.num_rows:
            continue
        k, p = batch.column(key).to_numpy(), batch.column("part").to_numpy()
        last = int(np.flatnonzero((k != k[-1]) | (p != p[-1]))[-1]) + 1 if k[0] != k[-1] or p[0] != p[-1] else 0
        if held and (last or held[-1].column(key)[-1].as_py() != k[0] or held[-1].column("part")[-1].as_py() != p[0]):
            table = pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            yield table, ends(table)
            held = []
        elif last:
            table = pa.Table.from_batches([batch.slice(0, last)])
            yield table, ends(table)
        held.append(batch.slice(last))
    if held:
        table = pa.Table.from_batches(held)
        yield table, ends(table)


def where(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The parts and blocks of the rows of ``in_blocks``, for ``across``."""
    return table.column("part").to_numpy(), table.column("block").to_numpy()


def across(placed: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places of one group belong to its part: those of two blocks have one member in each."""
    part, block = placed
    return ((part[i] >> 31) == (part[i] & HALF)) | (block[i] != block[j])


def each_part(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (key, part) of ``in_blocks`` by themselves."""
    for table, end in whole_parts(batches, key):
        at = 0
        while at < len(end):
            yield table.slice(at, int(end[at]) - at)
            at = int(end[at])


def pairs_at(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within groups, by rising distance; ``end`` as of ``whole_parts``."""
    i = np.arange(len(end))
    for step in range(1, len(end)):
        i = i[i + step < end[i]]
        if not len(i):
            return
        yield i, i + step
