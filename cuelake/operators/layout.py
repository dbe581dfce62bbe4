"""Layout analysis of cue bitmaps: blocks, writing mode, units and glyph estimates.

The grain is the cue: every image is analysed by itself with NumPy inside one Arrow-fed job, with
thresholds in the closure. What relational queries need of the same arithmetic is in
functions.geometry and in ``gap_cluster`` below.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.geometry import TUNING, upper_median

#: The blank inside a glyph, what is main text, the depth of cuts, units believed, and overlaps in thousandths.
RASTER_GAP, MAIN_PERCENT, CUT_DEPTH, MOST_UNITS, SIDE_BY_SIDE, AMBIGUOUS = 2, 72, 6, 8, 400, 600


# relational forms


def gap_cluster(df: DataFrame, *, by: str, position: str, max_gap: int) -> DataFrame:
    """(by, start, end, positions): half-open bands of positions, joined across blanks of up to ``max_gap``."""
    w = Window.partitionBy(by).orderBy(position)
    rows = df.select(by, F.col(position).cast("bigint").alias(position)).distinct()
    starts = F.coalesce(F.col(position) - F.lag(position).over(w) - 1 > max_gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_starts", starts).withColumn("_band", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "_band").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.count("*").alias("positions")).drop("_band")


def axis_activity(pixels: DataFrame, *, cue: str, axis: str, ink: Column, span: Column) -> DataFrame:
    """(cue, axis, ink): rows or columns with enough ink, at least two pixels and one in 600 of ``span``."""
    counts = pixels.groupBy(cue, axis).agg(F.count_if(ink).alias("ink"), F.max(span).alias("_span"))
    return counts.where(F.col("ink") >= F.greatest(F.lit(2), F.floor(F.col("_span") / 600))).drop("_span")


def tight_bounds(pixels: DataFrame, *, cue: str, x: str, y: str, ink: Column) -> DataFrame:
    """(cue, x, y, width, height) of the ink of each cue that has any."""
    return pixels.where(ink).groupBy(cue).agg(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x) - F.min(x) + 1).alias("width"), (F.max(y) - F.min(y) + 1).alias("height"))


def band_stats(bands: DataFrame, *, by: str) -> DataFrame:
    """(by, bands, median_extent, median_gap, max_extent); medians are the upper middle, 0 if there is none."""
    listed = bands.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"))
    gaps = F.transform(F.slice("b", F.lit(2), F.greatest(F.lit(0), F.size("b") - 1)), lambda x, i: F.greatest(F.lit(0), x.start - F.get(F.col("b"), i.cast("int")).end))
    extents = F.transform("b", lambda x: x.end - x.start)
    return listed.select(by, F.size("b").alias("bands"), upper_median(extents).alias("median_extent"), upper_median(gaps).alias("median_gap"), F.array_max(extents).alias("max_extent"))


def main_bands(bands: DataFrame, *, by: str, extent: Column) -> DataFrame:
    """Bands at least 72 % as long as the longest of their group."""
    return bands.withColumn("_extent", extent).withColumn("_longest", F.max("_extent").over(Window.partitionBy(by))).where(F.col("_extent") * 100 >= F.col("_longest") * MAIN_PERCENT).drop("_extent", "_longest")


def ambiguous_neighbours(blocks: DataFrame, *, cue: str, order: str, y: str, height: str) -> DataFrame:
    """(cue, first, second, overlap) of blocks that follow each other with 400 to 600 thousandths of overlap."""
    from cuelake.functions.geometry import overlap_milli

    w = Window.partitionBy(cue).orderBy(order)
    rows = blocks.select(cue, F.col(order).alias("first"), F.lead(order).over(w).alias("second"), overlap_milli(F.col(y), F.col(height), F.lead(y).over(w), F.lead(height).over(w)).alias("overlap"))
    return rows.where(F.col("second").isNotNull() & F.col("overlap").between(SIDE_BY_SIDE, AMBIGUOUS))


# the analysis of one mask

Rect = tuple[int, int, int, int]  # left, top, right, bottom


def _bands(active: np.ndarray, offset: int, gap: int) -> list[tuple[int, int]]:
    at = np.flatnonzero(active)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) - 1 > gap)
    return [(int(a) + offset, int(b) + 1 + offset) for a, b in zip(at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))], strict=True)]


def _axis_bands(ink: np.ndarray, r: Rect, axis: int, gap: int) -> list[tuple[int, int]]:
    """Bands of rows (axis 0) or columns (axis 1) of a part of the mask."""
    part = ink[r[1] : r[3], r[0] : r[2]]
    across = part.shape[1 - axis]
    return _bands(part.sum(axis=1 - axis) >= max(2, across // 600), r[1 - axis], gap)


def _tight(ink: np.ndarray, r: Rect) -> Rect | None:
    part = ink[r[1] : r[3], r[0] : r[2]]
    rows, cols = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
    if not len(rows):
        return None
    return r[0] + int(cols[0]), r[1] + int(rows[0]), r[0] + int(cols[-1]) + 1, r[1] + int(rows[-1]) + 1


def _middle(values: list[int]) -> int:
    return sorted(values)[len(values) // 2] if values else 0


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5)) if x > 0 else 0


def _split(ink: np.ndarray, area: Rect, separation: int) -> list[Rect]:
    """Parts between blanks wider than ``separation``, columns before rows, left to right and top to bottom."""
    done, todo = [], [(area, CUT_DEPTH)]
    while todo:
        r, depth = todo.pop()
        r = _tight(ink, r)
        if r is None:
            continue
        columns = _axis_bands(ink, r, 1, separation) if depth else []
        rows = _axis_bands(ink, r, 0, separation) if depth and len(columns) < 2 else []
        if len(columns) > 1:
            todo += [((a, r[1], b, r[3]), depth - 1) for a, b in reversed(columns)]
        elif len(rows) > 1:
            todo += [((r[0], a, r[2], b), depth - 1) for a, b in reversed(rows)]
        else:
            done.append(r)
    return done


def _absorb(rects: list[Rect], least: int) -> list[tuple[Rect, int]]:
    """Small parts joined to the part whose centre is nearest, smallest first; how many each has taken in."""
    parts = [[r, 0] for r in rects]
    area = lambda p: (p[0][2] - p[0][0]) * (p[0][3] - p[0][1])
    while len(parts) > 1:
        small = min(parts, key=area)
        if area(small) >= least:
            break
        parts.remove(small)
        s = small[0]
        host = min(parts, key=lambda p: abs(p[0][0] + p[0][2] - s[0] - s[2]) + abs(p[0][1] + p[0][3] - s[1] - s[3]))
        h = host[0]
        host[0], host[1] = (min(h[0], s[0]), min(h[1], s[1]), max(h[2], s[2]), max(h[3], s[3])), host[1] + small[1] + 1
    return [(r, n) for r, n in parts]


def _overlap(a: Rect, b: Rect) -> int:
    shared, shorter = min(a[3], b[3]) - max(a[1], b[1]), min(a[3] - a[1], b[3] - b[1])
    return shared * 1000 // shorter if shared > 0 and shorter else 0


def _reading_order(parts: list[tuple[Rect, int]], right_to_left: bool) -> list[tuple[Rect, int]]:
    """Stable insertion by the pairwise rule: stacked by top, side by side in the script's direction."""

    def before(a: Rect, b: Rect) -> bool:
        if _overlap(a, b) < SIDE_BY_SIDE:
            return a[1] < b[1]
        return a[2] > b[2] if right_to_left else a[0] < b[0]

    out: list[tuple[Rect, int]] = []
    for p in parts:
        at = len(out)
        while at and before(p[0], out[at - 1][0]):
            at -= 1
        out.insert(at, p)
    return out


def _mode(aspect: int, rows: int, columns: int) -> tuple[str, str]:
    if aspect >= 2000 or aspect <= 500:
        return ("horizontal_tb" if aspect >= 2000 else "vertical_rl"), "aspect"
    if columns == 1 and rows > 1:
        return "vertical_rl", "single_column"
    return "horizontal_tb", "single_row" if rows == 1 and columns > 1 else "fallback"


def _rect(r: Rect) -> dict:
    return {"x": r[0], "y": r[1], "width": r[2] - r[0], "height": r[3] - r[1]}


def _block(ink: np.ndarray, r: Rect) -> dict:
    rows, columns = _axis_bands(ink, r, 0, RASTER_GAP), _axis_bands(ink, r, 1, RASTER_GAP)
    aspect = (r[2] - r[0]) * 1000 // (r[3] - r[1])
    mode, rule = _mode(aspect, len(rows), len(columns))
    vertical = mode == "vertical_rl"
    across, along = (columns, rows) if vertical else (rows, columns)
    gap = _middle([max(0, b[0] - a[1]) for a, b in zip(along, along[1:], strict=False)])
    em = max(1, _middle([b - a for a, b in across]) + gap)
    longest = max((b - a for a, b in across), default=0)
    main = [(a, b) for a, b in across if (b - a) * 100 >= longest * MAIN_PERCENT]
    units = len(main) if 1 <= len(main) <= MOST_UNITS else None
    glyphs = []
    for a, b in main if units else []:
        t = _tight(ink, (a, r[1], b, r[3]) if vertical else (r[0], a, r[2], b))
        span = 0 if t is None else (t[3] - t[1] if vertical else t[2] - t[0])
        glyphs.append(max(1, (span + gap + em // 2) // em))
    return {"bounds": _rect(r), "writing_mode": mode, "source": "detected", "units": units, "em": em, "expected_glyphs": glyphs, "row_bands": len(rows), "column_bands": len(columns), "aspect_ratio_milli": aspect, "rule": rule}


def _doubt(code: str, a: int | None = None, b: int | None = None) -> dict:
    return {"code": code, "a": a, "b": b}


def clamped(tuning: dict | None) -> dict[str, float]:
    given = tuning or {}
    out = {}
    for name, (low, high, default) in TUNING.items():
        x = given.get(name, default)
        out[name] = default if x is None or x != x else min(high, max(low, x))
    return out


def analyse(ink: np.ndarray, tuning: dict | None = None, right_to_left: bool = False) -> dict:
    """{blocks, doubts} of a mask (height x width, true where ink); never fails."""
    t = clamped(tuning)
    h, w = ink.shape
    whole = {"bounds": _rect((0, 0, w, h)), "writing_mode": "horizontal_tb", "source": "whole_cue", "units": None, "em": 0, "expected_glyphs": [], "row_bands": 0, "column_bands": 0, "aspect_ratio_milli": w * 1000 // h if h else 4294967295, "rule": "fallback"}
    content = _tight(ink, (0, 0, w, h))
    if content is None:
        return {"blocks": [whole], "doubts": [_doubt("no_foreground")]}
    rows, columns = _axis_bands(ink, content, 0, RASTER_GAP), _axis_bands(ink, content, 1, RASTER_GAP)
    em = max([1, *(b - a for a, b in (rows if len(rows) <= len(columns) else columns))])
    parts = _absorb(_split(ink, content, max(1, _half_up(em * t["separation_em"]))), _half_up(em * t["minimum_block_em2"]) * em)
    if len(parts) > t["maximum_blocks"]:
        return {"blocks": [whole], "doubts": [_doubt("block_count_capped", len(parts))]}
    parts = _reading_order(parts, right_to_left)
    blocks, doubts = [], []
    for i, (r, taken) in enumerate(parts):
        doubts += [_doubt("tiny_block_merged", i)] * taken
        blocks.append(_block(ink, r))
        if blocks[-1]["rule"] == "fallback":
            doubts.append(_doubt("ambiguous_writing_mode", i))
    doubts += [_doubt("ambiguous_reading_order", i, i + 1) for i in range(len(parts) - 1) if SIDE_BY_SIDE <= _overlap(parts[i][0], parts[i + 1][0]) <= AMBIGUOUS]
    return {"blocks": blocks, "doubts": doubts}


RECT = "struct<x:int,y:int,width:int,height:int>"
BLOCK = f"struct<bounds:{RECT},writing_mode:string,source:string,units:int,em:int,expected_glyphs:array<int>,row_bands:int,column_bands:int,aspect_ratio_milli:bigint,rule:string>"
LAYOUT = f"cue_id string, width int, height int, blocks array<{BLOCK}>, doubts array<struct<code:string,a:int,b:int>>, error string"


# images


def read_png(data: bytes) -> np.ndarray:
    """Height x width x 4 of an 8-bit PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("unsupported PNG")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for y in range(h):
        row, f = raw[y, 1:].astype(np.int64), raw[y, 0]
        if f == 1:
            row = np.cumsum(row.reshape(w, channels), axis=0).reshape(-1)
        elif f == 2:
            row = row + above
        elif f in (3, 4):
            for x in range(len(row)):
                a = row[x - channels] & 255 if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - v), i, v) for i, v in enumerate((a, b, c))))[2]
                row[x] = (row[x] + guess) & 255
        above = row & 255
        out[y] = above
    px = out.reshape(h, w, channels)
    full = np.full((h, w, 1), 255, np.uint8)
    if head[3] == 3:
        alpha = np.full(256, 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        return np.concatenate((palette[px[:, :, 0]], alpha[px[:, :, :1]]), axis=2)
    gray = {1: [px, px, px, full], 2: [px[:, :, :1]] * 3 + [px[:, :, 1:]], 3: [px, full], 4: [px]}[channels]
    return np.concatenate(gray, axis=2)


def foreground(rgba: np.ndarray) -> np.ndarray:
    """Ink: pixels that differ from the mean of the corners by more than 14 in a channel; clear ones over an opaque ground are never ink."""
    c = rgba[[0, 0, -1, -1], [0, -1, 0, -1]].astype(np.int64).sum(axis=0) // 4
    return (np.abs(rgba.astype(np.int64) - c) > 14).any(axis=2) & ~((rgba[:, :, 3] < 16) & (c[3] >= 16))


def foreground_masks(images: DataFrame, *, cue: str = "cue_id", image: str = "image") -> DataFrame:
    """(cue_id, width, height, ink, error): one byte a pixel, row by row, from PNG images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    ink = foreground(read_png(bytes(r.image)))
                    rows.append((r.cue_id, ink.shape[1], ink.shape[0], ink.astype(np.uint8).tobytes(), None))
                except (ValueError, KeyError, TypeError, zlib.error, struct.error) as e:
                    rows.append((r.cue_id, None, None, None, f"the cue bitmap could not be decoded: {e}"))
            out = pd.DataFrame(rows, columns=["cue_id", "width", "height", "ink", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return images.select(F.col(cue).cast("string").alias("cue_id"), F.col(image).alias("image")).mapInPandas(run, "cue_id string, width int, height int, ink binary, error string")


def analyze_layout(masks: DataFrame, tuning: dict | None = None, *, right_to_left: bool = False) -> DataFrame:
    """Layout of every mask (cue_id, width, height, ink): blocks in reading order, doubts, or an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                data = np.frombuffer(bytes(r.ink), np.uint8) if r.ink is not None else np.zeros(0, np.uint8)
                if not len(data) or len(data) != r.width * r.height:
                    rows.append((r.cue_id, None, None, [], [], "the cue bitmap has no pixels"))
                    continue
                found = analyse(data.reshape(int(r.height), int(r.width)) > 0, tuning, right_to_left)
                rows.append((r.cue_id, int(r.width), int(r.height), found["blocks"], found["doubts"], None))
            out = pd.DataFrame(rows, columns=["cue_id", "width", "height", "blocks", "doubts", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return masks.select("cue_id", "width", "height", "ink").mapInPandas(run, LAYOUT)


def layout_doubts(layout: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    return layout.select(cue, F.explode("doubts").alias("d")).select(cue, "d.*")


def crop_blocks(images: DataFrame, layout: DataFrame, *, cue: str = "cue_id") -> DataFrame:
    """(cue_id, block_no, image, error): each detected block with padding max(2, em / 4); whole-cue blocks pass unchanged."""
    from cuelake.operators.ingest import png_of

    blocks = layout.select(F.col(cue).alias("cue_id"), F.posexplode("blocks").alias("block_no", "b")).select("cue_id", "block_no", "b.source", "b.em", "b.bounds.*")
    rows = blocks.join(images.select(F.col(cue).cast("string").alias("cue_id"), "image"), "cue_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.source == "whole_cue":
                    out.append((r.cue_id, r.block_no, bytes(r.image), None))
                    continue
                rgba = read_png(bytes(r.image))
                h, w = rgba.shape[:2]
                if r.x >= w or r.y >= h or not r.width or not r.height:
                    out.append((r.cue_id, r.block_no, None, "the crop rectangle falls outside the cue bitmap"))
                    continue
                pad = max(2, r.em // 4)
                part = rgba[max(0, r.y - pad) : min(h, r.y + r.height + pad), max(0, r.x - pad) : min(w, r.x + r.width + pad), :3]
                out.append((r.cue_id, r.block_no, png_of(np.ascontiguousarray(part)), None))
            yield pd.DataFrame(out, columns=["cue_id", "block_no", "image", "error"])

    return rows.mapInPandas(run, "cue_id string, block_no int, image binary, error string")
