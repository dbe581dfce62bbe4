"""Column expressions on rectangles, palettes and layout figures; integers unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = ("top-left", "top-center", "top-right", "middle-left", "middle-center", "middle-right", "bottom-left", "bottom-center", "bottom-right")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    """Integer division of values that are not negative."""
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("bigint")


def third(start: Column, extent: Column, canvas: Column) -> Column:
    """0, 1 or 2: the third of the canvas in which the middle of an extent lies."""
    doubled = 3 * (2 * start + extent)
    return F.when(doubled < 2 * canvas, 0).when(doubled < 4 * canvas, 1).otherwise(2)


def nine_grid(x, y, w, h, cw, ch) -> Column:
    cell = third(big(y), big(h), big(ch)) * 3 + third(big(x), big(w), big(cw))
    return F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), cell.cast("int") + 1)


def canvas_origin(start, image, extent, offset) -> Column:
    """A bitmap coordinate on the canvas: the padding is half of what the image is larger than its box."""
    pad = F.floor(F.greatest(F.lit(0), big(image) - big(extent)) / 2)
    return (F.greatest(F.lit(0), big(start) - pad) + big(offset)).cast("bigint")


def cue_image_origin(start, image, extent) -> Column:
    """As a double, with half pixels."""
    return F.greatest(F.lit(0.0), big(start) - F.greatest(F.lit(0), big(image) - big(extent)) / 2.0)


#: Luminance, then red by Cr, green by Cb and Cr, blue by Cb, for high definition and standard.
COLOUR = {True: (1.164383, 1.792741, 0.213249, 0.532909, 2.112402), False: (1.164383, 1.596027, 0.391762, 0.812968, 2.017232)}


def palette_rgba(y, cr, cb, alpha, canvas_height) -> Column:
    """struct(r, g, b, a) of a palette entry; high definition above 576 lines."""

    def channels(hd: bool) -> list[Column]:
        l, r, g_cb, g_cr, b = COLOUR[hd]
        light, u, v = F.lit(l) * (big(y) - 16), big(cb) - 128, big(cr) - 128
        return [light + F.lit(r) * v, light - F.lit(g_cb) * u - F.lit(g_cr) * v, light + F.lit(b) * u]

    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.round(c).cast("bigint")))
    both = [F.when(big(canvas_height) > 576, a).otherwise(b) for a, b in zip(channels(True), channels(False), strict=True)]
    return F.struct(*[clamp(c).alias(n) for c, n in zip(both, "rgb", strict=True)], big(alpha).alias("a"))


def milli_ratio(width, height) -> Column:
    return F.when(big(height) == 0, F.lit(4294967295)).otherwise(div(big(width) * 1000, F.nullif(big(height), F.lit(0))))


def writing_mode(aspect, rows, columns) -> Column:
    """struct(mode, rule): shape first, band counts for what is nearly square."""
    pick = lambda mode, rule: F.struct(F.lit(mode).alias("mode"), F.lit(rule).alias("rule"))
    a, r, c = big(aspect), big(rows), big(columns)
    return (
        F.when(a >= 2000, pick("horizontal_tb", "aspect")).when(a <= 500, pick("vertical_rl", "aspect"))
        .when((c == 1) & (r > 1), pick("vertical_rl", "single_column")).when((r == 1) & (c > 1), pick("horizontal_tb", "single_row"))
        .otherwise(pick("horizontal_tb", "fallback"))
    )


def count_units(bands) -> Column:
    return F.when(big(bands).between(1, 8), big(bands))


def expected_glyphs(span, em, gap) -> Column:
    return F.greatest(F.lit(1), div(big(span) + big(gap) + div(big(em), 2), F.greatest(F.lit(1), big(em)))).cast("bigint")


def clamp_tuning(value: Column, low: float, high: float, default: float) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


#: Bounds and default of separation, least block area and most blocks.
TUNING = {"separation_em": (1.5, 8.0, 2.0), "minimum_block_em2": (0.0, 8.0, 0.5), "maximum_blocks": (1.0, 32.0, 8.0)}


def bootstrap_em(rows: Column, longest_row: Column, columns: Column, longest_column: Column) -> Column:
    return F.greatest(F.lit(1), F.when(rows <= columns, longest_row).otherwise(longest_column))


def upper_median(values: Column) -> Column:
    """The upper middle of an array, 0 if it is empty; null elements are not expected."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0))


def overlap_milli(y1: Column, h1: Column, y2: Column, h2: Column) -> Column:
    """How much of the shorter height two boxes share, in thousandths."""
    shared, shorter = F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2), F.least(h1, h2)
    return F.when((shared <= 0) | (shorter == 0), F.lit(0)).otherwise(div(shared * 1000, F.nullif(shorter, F.lit(0)))).cast("bigint")


def total_units(blocks: Column) -> Column:
    return F.when(F.exists(blocks, lambda b: b.units.isNull()), F.lit(None)).otherwise(F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + b.units))
