"""Consecutive numbers within groups of any size.

A window that numbers a group puts the whole group into one task. Here rows are dealt to tasks by
ranges of group and order, so that a large group is spread over as many tasks as its share of the
rows. Each task numbers what it has; a few counts, one for each group and task, say where each run
begins; and the rows get their numbers in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.sources.shared import checkpointed

#: How the number of a row within its task and the task's own are joined in one.
PLACE_BITS = 33
#: So many runs, a row of numbers and a group's key each, are broadcast; more of them are joined by shuffle.
MOST_RUNS = 200_000


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, *, tasks: int | None = None) -> DataFrame:
    """``rows`` with the column ``name``, which is replaced if it is there: 1, 2, ... within each group by ``order``, nulls first; a null group is one too.

    Rows equal in ``order`` are told apart by a hash of all their columns, so that they too are
    spread. The frame is computed once, into the shared folder; ``tasks`` is the session's number
    of shuffle partitions unless given.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
    packed = rows.select(F.struct(*kept).alias("row"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys: list[Column] = [F.col(f"g{i}") for i in range(len(group))]
    by = [*keys, *[F.col(f"o{i}") for i in range(len(order))], F.col("tie")]
    dealt = packed.withColumn("tie", F.xxhash64("row")).repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    placed = checkpointed(dealt.select("row", *keys, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", PLACE_BITS)
    runs = placed.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a group a row a task
    runs = checkpointed(runs.select("part", "first", before.alias("before"), *[k.alias(f"r{i}") for i, k in enumerate(keys)]))
    runs = F.broadcast(runs) if runs.count() <= MOST_RUNS else runs
    same = part == F.col("part")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"r{i}"))
    number = (F.col("at") - F.col("first") + F.col("before") + 1).alias(name)
    return placed.join(runs, same).select("row.*", number)
