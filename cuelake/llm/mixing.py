"""Mixing of sources to target weights along a curriculum, in DataFrame operations only.

Each source has a weight at the start and at the end of training, linear in between. The integral
of that schedule, scaled to the source's target, is its demand up to a time; the position of a
copy is the time at which the demand reaches the words before it. Words before a document are a
running sum in the order of a hash, taken in two steps so that no source has to pass through one
task: sums of the hash ranges of a source first, then the rows of one range. There are as many
ranges as keep one at some ten thousand rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.workdir import Scratch

#: Weights by the place of a source in code point order, and the start and end of its schedule; both repeat.
WEIGHTS, SCHEDULES = (5, 2, 1), ((2.0, 1.0), (1.0, 1.0), (1.0, 3.0))
#: Rows that a hash range should hold at most, if ranges are even.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _cycle(values: Sequence, place: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, *, share: float, most: float, weights: Sequence[int], schedules: Sequence[tuple[float, float]]) -> DataFrame:
    """(source, source_size, target, begin, finish) from (source, source_size); one row a source.

    Targets are in proportion to the weights, stopped at ``most`` times the size; what is over goes
    to the others by weight until none is above. Sorted by size over weight, the sources that stop
    are the first ones, so running sums give the level at once. The table has a row a source, so
    its windows are small whatever the corpus.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": _cycle(weights, F.col("place"), "double"), "begin": _cycle([s for s, _ in schedules], F.col("place"), "double"), "finish": _cycle([e for _, e in schedules], F.col("place"), "double")})
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the level if all sources before this one stop and this one doesn't
    level = (F.col("total") * share - F.col("full") * most) / F.col("open")
    stops = F.col("source_size") * most <= level * F.col("weight")
    marked = sums.withColumns({"level": level, "stops": stops})
    final = marked.withColumn("level", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("level")))).over(everything).getField("level"))
    target = F.when(F.col("stops") | F.col("level").isNull(), F.col("source_size") * most).otherwise(F.col("level") * F.col("weight"))
    return final.select("source", "source_size", target.alias("target"), "begin", "finish")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, whole_rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, part, position, words_before, begin, finish) of every row.

    With ``whole_rows`` the row itself follows as the struct ``row``, so no column of it can clash.

    size counts the words of a text (null: none). A source takes its documents in the order of an
    MD5 of id and text, again from the first when all are taken, until its target is met: ``copies``
    times as a whole, and the document at the end for its first ``part`` words. position is the
    time, 0 to 1, of the first copy; null if nothing is taken. Rows of a null source are a source
    of their own, the last; repeated rows follow each other. Empty texts and empty
    sources take nothing; an empty table gives an empty result.
    """
    digits = max(2, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16)))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    content = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"), F.md5(content).alias("_hash"), *row)
    rows = rows.withColumn("_range", F.substring("_hash", 1, digits))
    if not whole_rows:  # words are counted once
        with Scratch(docs.sparkSession, "mixing") as scratch:
            rows = scratch.keep(scratch.save(rows, "sizes"))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("held").alias("source_size")), share=share, most=most, weights=weights, schedules=schedules).withColumnRenamed("source", "_of")
    ranges = ranges.join(targets, F.col("source").eqNullSafe(F.col("_of"))).select(F.col("source").alias("_source"), F.col("_range").alias("_range2"), "_before", "source_size", "target", "begin", "finish")
    inside = Window.partitionBy("_source", "_range").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_range2"))).withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.floor("target")
    copies = F.when(F.col("source_size") > 0, F.floor(words / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(F.lit(0))
    rest = words - F.col("_copies") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", rest - F.col("_at")))
    placed = placed.withColumn("_copies", copies.cast("long")).withColumn("_part", part.cast("long"))
    placed = placed.withColumns({"copies": F.col("_copies") + F.when((F.col("size") > 0) & (F.col("_part") == F.col("size")), 1).otherwise(0), "part": F.when(F.col("_part") < F.col("size"), F.col("_part")).otherwise(F.lit(0))})
    taken = F.col("copies") * F.col("size") + F.col("part")
    demand = F.col("_at") / F.nullif(F.col("target"), F.lit(0.0))
    position = F.when(taken > 0, demand * (F.col("begin") + F.col("finish")) / (F.col("begin") + F.sqrt(F.col("begin") * F.col("begin") + (F.col("finish") * F.col("finish") - F.col("begin") * F.col("begin")) * demand)))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("copies").cast("long"), F.col("part").cast("long"), position.alias("position"), F.col("_at").alias("words_before"), "begin", "finish", *(["row"] if whole_rows else []))


def copy_position(copy: Column) -> Column:
    """The time of the copy with this number, from 0, of a row of ``mix``."""
    demand = (F.col("words_before") + copy * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
    begin, finish = F.col("begin"), F.col("finish")
    return demand * (begin + finish) / (begin + F.sqrt(begin * begin + (finish * finish - begin * begin) * demand))
