"""Painted masks with known blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import geometry as G
from cuelake.operators import layout as L
from cuelake.operators import survey
from cuelake.operators.ingest import png_of


def run(ink, x, y, em, n, vertical=False, percent=100, step=None):
    """Squares of nearly an em, one per step."""
    inset = max(1, em // 16)
    size, step = em * percent // 100 - 2 * inset, step or em * percent // 100
    for i in range(n):
        a, b = (x, y + i * step) if vertical else (x + i * step, y)
        ink[b + inset : b + inset + size, a + inset : a + inset + size] = True


def blank(w, h):
    return np.zeros((h, w), bool)


def test_vertical_and_horizontal():
    ink = blank(1062, 747)
    run(ink, 990, 21, 54, 4, vertical=True)
    run(ink, 20, 614, 53, 10)
    run(ink, 20, 675, 53, 9)
    blocks = L.analyse(ink, right_to_left=True)["blocks"]
    assert [b["writing_mode"] for b in blocks] == ["vertical_rl", "horizontal_tb"] and [b["units"] for b in blocks] == [1, 2]
    assert blocks[0]["expected_glyphs"] == [4]
    assert all(abs(a - b) <= 1 for a, b in zip(blocks[1]["expected_glyphs"], (10, 9), strict=True))


def test_wide_blanks_and_ruby_stay_in_one_block():
    ink = blank(1000, 110)
    run(ink, 20, 52, 52, 5)
    ink[55:101, 20 + 5 * 52 + 23 : 20 + 5 * 52 + 29] = True  # a narrow mark before an empty cell
    run(ink, 20 + 7 * 52, 52, 52, 8)
    run(ink, 30, 20, 52, 4, percent=50)
    blocks = L.analyse(ink)["blocks"]
    assert len(blocks) == 1 and blocks[0]["units"] == 1 and blocks[0]["em"] >= 40
    assert len(L.analyse(ink, {"separation_em": 1.5})["blocks"]) > 1


def test_stacked_blocks_by_height():
    ink = blank(700, 700)
    run(ink, 40, 500, 52, 8)
    run(ink, 60, 40, 52, 6)
    ys = [b["bounds"]["y"] for b in L.analyse(ink)["blocks"]]
    assert len(ys) == 2 and ys[0] < ys[1]


@pytest.mark.parametrize("right_to_left", [True, False])
def test_side_by_side_by_script(right_to_left):
    ink = blank(900, 400)
    run(ink, 100, 40, 52, 6, vertical=True)
    run(ink, 700, 40, 52, 6, vertical=True)
    xs = [b["bounds"]["x"] for b in L.analyse(ink, right_to_left=right_to_left)["blocks"]]
    assert (xs[0] > xs[1]) == right_to_left


def test_speck_is_absorbed():
    ink = blank(900, 300)
    run(ink, 40, 100, 52, 10)
    ink[140:146, 700:706] = True
    found = L.analyse(ink)
    assert len(found["blocks"]) == 1 and [d["code"] for d in found["doubts"]] == ["tiny_block_merged"]


def test_degraded():
    assert [d["code"] for d in L.analyse(blank(200, 100))["doubts"]] == ["no_foreground"]
    ink = blank(2400, 200)
    run(ink, 10, 50, 40, 10, step=240)
    found = L.analyse(ink)
    assert found["blocks"][0]["source"] == "whole_cue" and found["doubts"][0]["code"] == "block_count_capped"


def test_tuning():
    assert L.clamped({"separation_em": 0, "minimum_block_em2": -1, "maximum_blocks": 0}) == {"separation_em": 1.5, "minimum_block_em2": 0.0, "maximum_blocks": 1.0}
    assert L.clamped({"separation_em": float("nan")})["separation_em"] == 2.0


def test_bands():
    on = lambda s: np.array([c == "#" for c in s])
    assert L._bands(on(".#.#..."), 0, 2) == [(1, 4)] and L._bands(on("#...#"), 0, 2) == [(0, 1), (4, 5)] and L._bands(on("..."), 0, 2) == []
    assert L._middle([2, 50, 10]) == 10 and L._middle([]) == 0


def test_nine_cells(spark):
    rows = spark.createDataFrame([(x, y) for y in (40, 140, 240) for x in (40, 140, 240)], "x int, y int")
    found = rows.select(G.nine_grid("x", "y", F.lit(20), F.lit(20), F.lit(300), F.lit(300)).alias("p")).collect()
    assert [r.p for r in found] == list(G.POSITIONS)


def test_canvas_coordinates(spark):
    one = spark.range(1)
    o = lambda start, image, extent, at: one.select(G.canvas_origin(F.lit(start), F.lit(image), F.lit(extent), F.lit(at)).alias("v")).first().v
    assert (o(700, 552, 520, 0), o(850, 112, 80, 0)) == (684, 834) and (o(700, 552, 520, 16), o(850, 112, 80, 16)) == (700, 850)


def test_jobs_over_images(spark):
    ink = blank(400, 120)
    run(ink, 20, 40, 40, 6)
    rgb = np.where(ink[:, :, None], 255, 0).astype(np.uint8).repeat(3, axis=2)
    images = spark.createDataFrame([("a", bytearray(png_of(rgb))), ("b", bytearray(b"no image")), ("c", None)], "cue_id string, image binary")
    masks = L.foreground_masks(images)
    found = {r.cue_id: r for r in L.analyze_layout(masks).collect()}
    assert found["a"].blocks[0].expected_glyphs == [6] and found["a"].error is None and found["b"].error and found["c"].error
    flags = survey.layout_sweep(masks, [{}, {"maximum_blocks": 1}]).orderBy("candidate").collect()
    assert [(r.cues, r.failed) for r in flags] == [(3, 2), (3, 2)]
    crops = L.crop_blocks(images, L.analyze_layout(masks)).collect()
    assert len(crops) == 1 and L.read_png(bytes(crops[0].image)).shape[1] < 400
    assert survey.survey_block_counts(L.analyze_layout(masks)).first().blocks == 1
    assert L.layout_doubts(L.analyze_layout(masks)).count() == 0


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (5, 7, 3), np.uint8)
    raw = b""
    for y, f in enumerate((0, 1, 2, 3, 4)):
        line, up = px[y].reshape(-1).astype(int), (px[y - 1].reshape(-1).astype(int) if y else np.zeros(21, int))
        left, corner = np.concatenate((np.zeros(3, int), line[:-3])), np.concatenate((np.zeros(3, int), up[:-3]))
        paeth = [min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2] for a, b, c in zip(left, up, corner, strict=True) for p in [a + b - c]]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[f]
        raw += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (L.read_png(png)[:, :, :3] == px).all()
