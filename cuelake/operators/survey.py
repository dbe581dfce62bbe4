"""Layout survey: what the analysis of a whole track looks like, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.geometry import canvas_origin
from cuelake.operators.layout import analyze_layout


def survey_block_counts(layout: DataFrame) -> DataFrame:
    return layout.where("error is null").groupBy(F.size("blocks").alias("blocks")).agg(F.count("*").alias("cues"))


def survey_hist(rows: DataFrame, by: str, size: Column) -> DataFrame:
    """How many groups have how many members: the block-count histogram of any table."""
    return rows.groupBy(by).agg(size.alias("blocks")).groupBy("blocks").agg(F.count("*").alias("cues"))


def survey_writing_modes(layout: DataFrame) -> DataFrame:
    return layout.select(F.explode("blocks.writing_mode").alias("writing_mode")).groupBy("writing_mode").agg(F.count("*").alias("blocks"))


def survey_doubts(layout: DataFrame) -> DataFrame:
    return layout.select(F.explode("doubts.code").alias("code")).groupBy("code").agg(F.count("*").alias("doubts"))


def survey_flags(layout: DataFrame) -> DataFrame:
    """All, failed, vertical, mixed and degraded cues in one pass."""
    vertical = F.exists("blocks", lambda b: b.writing_mode == "vertical_rl")
    horizontal = F.exists("blocks", lambda b: b.writing_mode == "horizontal_tb")
    degraded = F.exists("blocks", lambda b: b.source == "whole_cue")
    return layout.agg(F.count("*").alias("cues"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(vertical).alias("vertical"), F.count_if(vertical & horizontal).alias("mixed"), F.count_if(degraded).alias("degraded"))


def survey_notable(layout: DataFrame, geometry: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    """Cues that aren't one confident horizontal block, and failures; bounds are on the canvas."""
    plain = (F.size("blocks") == 1) & (F.size("doubts") == 0) & (F.get("blocks", F.lit(0)).writing_mode == "horizontal_tb") & (F.get("blocks", F.lit(0)).source == "detected")
    rows = layout.where(F.col("error").isNotNull() | ~plain).join(geometry.select(cue, "geometry"), cue, "left")
    g = F.col("geometry")
    moved = F.transform("blocks", lambda b: F.struct(canvas_origin(g.x, g.image_width, g.width, b.bounds.x).alias("x"), canvas_origin(g.y, g.image_height, g.height, b.bounds.y).alias("y"), b.bounds.width.alias("width"), b.bounds.height.alias("height"), b.writing_mode.alias("writing_mode")))
    return rows.select(cue, moved.alias("blocks"), F.col("doubts.code").alias("doubts"), "error")


def survey_sweep(positions: DataFrame, thresholds: DataFrame, *, by: str = "cue_id", position: str = "position", threshold: str = "max_gap", most_bands: int = 8) -> DataFrame:
    """(threshold, cues, bands, single, capped) of each row of ``thresholds``: how many bands the cues would have if blanks up to that size were joined, how many cues would be one band, and how many would have more than ``most_bands``.

    One pass for all thresholds: a cue has one band and one more for each gap above the threshold,
    it is single if its largest gap is not above it, and capped if its ``most_bands``-th largest is.
    So three counts by gap say everything, and a running sum from the largest gap down meets the
    thresholds in order. Rows of that window are the different gaps, at most as many as a canvas has
    pixels, and the thresholds. Repeated positions count once, null ones not at all.
    """
    rows = positions.select(F.col(by).alias("_by"), F.col(position).cast("bigint").alias("_at")).where("_at is not null").distinct()
    gap = F.col("_at") - F.lag("_at").over(Window.partitionBy("_by").orderBy("_at")) - 1
    ranked = rows.withColumn("_gap", gap).withColumn("_rank", F.row_number().over(Window.partitionBy("_by").orderBy(F.col("_gap").desc_nulls_last())))
    # a cue's first position has no gap: these rows count the cues
    counts = ranked.groupBy(F.col("_gap").alias("_value")).agg(F.count("*").alias("_n"), F.count_if(F.col("_rank") == 1).alias("_largest"), F.count_if(F.col("_rank") == most_bands).alias("_over"))
    asked = thresholds.select(F.col(threshold).cast("double").alias("_value"), F.lit(True).alias("_asked"))
    both = counts.select(F.col("_value").cast("double").alias("_value"), F.lit(False).alias("_asked"), "_n", "_largest", "_over").unionByName(asked, allowMissingColumns=True)
    above = Window.orderBy(F.col("_value").desc_nulls_first(), F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, -1)  # of equal ones the threshold first
    cues = F.sum(F.when(F.col("_value").isNull() & ~F.col("_asked"), F.col("_n"))).over(Window.orderBy(F.col("_value").desc_nulls_first(), F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("_value").isNotNull(), F.col(c))).over(above), F.lit(0))
    swept = both.select("_value", "_asked", F.coalesce(cues, F.lit(0)).alias("cues"), total("_n").alias("_above"), total("_largest").alias("_several"), total("_over").alias("capped")).where("_asked")
    return swept.select(F.col("_value").alias(threshold), "cues", (F.col("cues") + F.col("_above")).alias("bands"), (F.col("cues") - F.col("_several")).alias("single"), "capped")


def layout_sweep(masks: DataFrame, grid: list[dict]) -> DataFrame:
    """``survey_flags`` of the whole layout for each candidate of several thresholds in ``grid``; masks are read once a candidate."""
    out = None
    for i, tuning in enumerate(grid):
        one = survey_flags(analyze_layout(masks, tuning)).withColumn("candidate", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def threshold_sweep(rows: DataFrame, thresholds: list[float], value: Column) -> DataFrame:
    """(threshold, rows, above): the sweep in relational form, each row exploded over a literal list of candidates."""
    listed = rows.select(value.alias("value")).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return listed.groupBy("threshold").agg(F.count("*").alias("rows"), F.count_if(F.col("value") > F.col("threshold")).alias("above"))
