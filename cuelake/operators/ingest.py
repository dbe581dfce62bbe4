"""Ingest of image-subtitle streams: segments to display sets, objects, rendered images and cues.

One Spark job: display sets and epochs are numbered per file by windows, rendering runs for each
(file, epoch) by itself, as an epoch needs nothing from the ones before, and timing looks across
epochs at the next display set only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.operators.numbering import numbered

#: Segment kinds, ticks a millisecond, the pixels of padding and what an open cue lasts.
PALETTE, OBJECT, PRESENTATION, END = 0x14, 0x15, 0x16, 0x80
TICKS, PADDING, FALLBACK_MS = 90, 16, 5000


def assemble_display_sets(segments: DataFrame, *, path: str = "path") -> DataFrame:
    """Segments with ``epoch`` and ``set_no``: a presentation with a non-zero state starts an epoch, an end segment closes a set."""
    before = Window.partitionBy(path).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(path).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.shiftright(F.conv(F.hex(F.substring("payload", 8, 1)), 16, 10).cast("int"), 6)
    starts = (F.col("kind") == PRESENTATION) & (F.octet_length("payload") >= 11) & (state != 0)
    return segments.withColumns({"epoch": F.sum(F.coalesce(starts, F.lit(False)).cast("bigint")).over(upto), "set_no": F.coalesce(F.sum((F.col("kind") == END).cast("bigint")).over(before), F.lit(0)) + 1})


def reassemble_objects(objects: DataFrame, keys: tuple[str, ...] = ("path", "epoch", "object_id")) -> DataFrame:
    """Objects put together from fragments (keys, seg_no, first, declared, data): ``rle``, ``declared`` and ``error``.

    Each first fragment starts a version of the object; continuations belong to the version before them.
    """
    w = Window.partitionBy(*keys).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = objects.withColumn("version", F.sum(F.col("first").cast("bigint")).over(w))
    whole = rows.groupBy(*keys, "version").agg(F.max(F.when(F.col("first"), F.col("declared"))).alias("declared"), F.aggregate(F.array_sort(F.collect_list(F.struct("seg_no", "data"))), F.lit("").cast("binary"), lambda a, f: F.concat(a, f.data)).alias("rle"), F.min("seg_no").alias("seg_no"))
    length = F.octet_length("rle")
    error = F.when(F.col("version") == 0, "continuation for unknown object").when(length > F.col("declared"), "object exceeds declared length").when(length < F.col("declared"), "incomplete object")
    return whole.withColumn("error", error)


def decode_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """Palette numbers, height x width, of run-length data; ValueError where it doesn't fit."""
    out, at, filled, lines = np.zeros(width * height, np.uint8), 0, 0, 0
    while at < len(data) and lines < height:
        color, run = data[at], 1
        at += 1
        if color == 0:
            need = at + 1
            if need > len(data):
                raise ValueError("truncated control sequence")
            flags = data[at]
            at, run = need, flags & 63
            extra = (1 if flags & 64 else 0) + (1 if flags & 128 else 0)
            if at + extra > len(data):
                raise ValueError("truncated run")
            if flags & 64:
                run, at = run << 8 | data[at], at + 1
            if flags & 128:
                color, at = data[at], at + 1
        if run == 0:
            if filled % width:
                raise ValueError("line does not match bitmap width")
            lines += 1
        elif filled + run > len(out):
            raise ValueError("run exceeds bitmap dimensions")
        else:
            out[filled : filled + run] = color
            filled += run
    if filled != len(out):
        raise ValueError(f"decoded {filled} pixels; expected {len(out)}")
    return out.reshape(height, width)


def rgba_of(y: int, cr: int, cb: int, alpha: int, hd: bool) -> tuple[int, int, int, int]:
    """A palette entry; halves round away from zero."""
    from cuelake.functions.geometry import COLOUR

    l, r, g_cb, g_cr, b = COLOUR[hd]
    light, u, v = l * (y - 16), cb - 128, cr - 128
    clamp = lambda x: int(min(255, max(0, np.floor(x + 0.5))))
    return clamp(light + r * v), clamp(light - g_cb * u - g_cr * v), clamp(light + b * u), alpha


def png_of(rgb: np.ndarray) -> bytes:
    """An uncropped RGB image as PNG."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate((np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


class _Epoch:
    """Palettes and objects of one epoch, filled segment by segment."""

    def __init__(self):
        self.palettes: dict[int, dict[int, tuple]] = {}
        self.objects: dict[int, list] = {}
        self.shown: dict | None = None

    def take(self, kind: int, p: bytes, pts: int) -> None:
        if kind == PRESENTATION:
            self.shown = self.presentation(p, pts)
        elif kind == PALETTE:
            if len(p) < 2 or (len(p) - 2) % 5:
                raise ValueError("malformed palette segment")
            hd = self.shown is None or self.shown["canvas_height"] > 576
            self.palettes.setdefault(p[0], {}).update({p[i]: rgba_of(p[i + 1], p[i + 2], p[i + 3], p[i + 4], hd) for i in range(2, len(p), 5)})
        elif kind == OBJECT:
            self.fragment(p)

    def presentation(self, p: bytes, pts: int) -> dict:
        if len(p) < 11:
            raise ValueError("presentation segment is too short")
        at, refs = 11, []
        for _ in range(p[10]):
            if at + 8 > len(p):
                raise ValueError("truncated presentation object reference")
            number, _, flag, x, y = struct.unpack_from(">HBBHH", p, at)
            at += 8
            crop = None
            if flag & 128:
                if at + 8 > len(p):
                    raise ValueError("truncated object crop rectangle")
                crop = struct.unpack_from(">HHHH", p, at)
                at += 8
            refs.append((number, bool(flag & 64), x, y, crop))
        w, h = struct.unpack_from(">HH", p)
        return {"canvas_width": w, "canvas_height": h, "palette": p[9], "refs": refs, "pts": pts}

    def fragment(self, p: bytes) -> None:
        if len(p) < 4:
            raise ValueError("object segment is too short")
        number = struct.unpack_from(">H", p)[0]
        if p[3] & 128:
            if len(p) < 11:
                raise ValueError("initial object segment is too short")
            declared = int.from_bytes(p[4:7], "big") - 4
            if declared < 0:
                raise ValueError("invalid object data length")
            self.objects[number] = [*struct.unpack_from(">HH", p, 7), declared, p[11:]]
        elif number not in self.objects:
            raise ValueError(f"continuation for unknown object {number}")
        else:
            self.objects[number][3] += p[4:]
        if len(self.objects[number][3]) > self.objects[number][2]:
            raise ValueError(f"object {number} exceeds declared length")

    def render(self) -> dict | None:
        """What the presentation shows: the visible part with padding; None if it shows nothing."""
        s = self.shown
        if s is None:
            raise ValueError("display end before presentation segment")
        if not s["refs"]:
            return None
        if s["palette"] not in self.palettes:
            raise ValueError(f"missing palette {s['palette']}")
        table = np.zeros((256, 4), np.uint8)
        for k, v in self.palettes[s["palette"]].items():
            table[k] = v
        placed = []
        for number, forced, x, y, crop in s["refs"]:
            if number not in self.objects:
                raise ValueError(f"missing object {number}")
            w, h, declared, data = self.objects[number]
            if len(data) != declared:
                raise ValueError(f"incomplete object {number}")
            cx, cy, cw, ch = crop or (0, 0, w, h)
            if not cw or not ch or cx + cw > w or cy + ch > h:
                raise ValueError(f"invalid crop for object {number}")
            placed.append((forced, x, y, table[decode_runs(data, w, h)[cy : cy + ch, cx : cx + cw]]))
        left, top = min(p[1] for p in placed), min(p[2] for p in placed)
        right, bottom = max(p[1] + p[3].shape[1] for p in placed), max(p[2] + p[3].shape[0] for p in placed)
        canvas = np.zeros((bottom - top, right - left, 4), np.uint8)
        for _, x, y, pixels in placed:
            part = canvas[y - top : y - top + pixels.shape[0], x - left : x - left + pixels.shape[1]]
            seen = pixels[:, :, 3] > 0
            part[seen] = pixels[seen]
        rows, cols = np.flatnonzero(canvas[:, :, 3].any(axis=1)), np.flatnonzero(canvas[:, :, 3].any(axis=0))
        if not len(rows):
            raise ValueError("rendered subtitle contains no visible pixels")
        part = canvas[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1].astype(np.uint16)
        rgb = np.zeros((part.shape[0] + 2 * PADDING, part.shape[1] + 2 * PADDING, 3), np.uint8)
        rgb[PADDING:-PADDING, PADDING:-PADDING] = part[:, :, :3] * part[:, :, 3:] // 255
        return {"x": left + int(cols[0]), "y": top + int(rows[0]), "width": part.shape[1], "height": part.shape[0], "image": png_of(rgb), "forced": any(p[0] for p in placed), "canvas_width": s["canvas_width"], "canvas_height": s["canvas_height"]}


RENDERED = "path string, set_no long, pts long, drawn boolean, canvas_width int, canvas_height int, x int, y int, width int, height int, forced boolean, image binary, error string"


def render_display_sets(numbered: DataFrame) -> DataFrame:
    """A row for each closed display set of ``assemble_display_sets``: image and box if it draws, or its error."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        epoch, rows, broken = _Epoch(), [], None
        for r in pdf.sort_values("seg_no").itertuples():
            try:
                if r.kind == END:
                    found = None if broken else epoch.render()
                    pts = epoch.shown["pts"] if epoch.shown else r.pts
                    rows.append({"path": r.path, "set_no": r.set_no, "pts": pts, "drawn": found is not None, **(found or {}), "error": broken})
                    broken = None
                elif broken is None:
                    epoch.take(r.kind, bytes(r.payload), r.pts)
            except ValueError as e:
                broken = str(e)
                if r.kind == END:
                    rows.append({"path": r.path, "set_no": r.set_no, "pts": r.pts, "drawn": False, "error": broken})
                    broken = None
        columns = [c.strip().split(" ")[0] for c in RENDERED.split(",")]
        out = pd.DataFrame(rows, columns=columns)
        for c in ("canvas_width", "canvas_height", "x", "y", "width", "height"):
            out[c] = out[c].astype("Int32")
        out["forced"] = out["forced"].astype("boolean")
        return out

    return numbered.groupBy("path", "epoch").applyInPandas(one, RENDERED)


def pts_ms(pts: str | Column) -> Column:
    p = F.col(pts) if isinstance(pts, str) else pts
    return F.floor((p * 1000 + 45000) / 90000).cast("bigint")


def cue_timing(sets: DataFrame, *, path: str = "path", order: str = "set_no", pts: str = "pts", drawn: str = "drawn") -> DataFrame:
    """Drawn display sets with ``start_ms``, ``end_ms``, ``inferred_end`` and ``error``.

    A drawn set ends when the next set starts, drawn or empty; the last one, if drawn, lasts five seconds.
    Fixed value: the error's message.
    """
    w = Window.partitionBy(path).orderBy(order)
    after = F.lead(pts).over(w)
    rows = sets.withColumns({"_next": after}).where(F.col(drawn))
    end = F.coalesce("_next", F.col(pts) + FALLBACK_MS * TICKS)
    rows = rows.withColumns({"inferred_end": F.col("_next").isNull(), "start_ms": pts_ms(pts), "end_ms": pts_ms(end), "_late": end <= F.col(pts)})
    return rows.withColumn("error", F.coalesce(F.when(F.col("_late"), F.lit("subtitle cue has a non-positive duration")), F.col("error") if "error" in sets.columns else F.lit(None).cast("string"))).drop("_next", "_late")


def number_cues(sets: DataFrame, *, track: str = "path", order: str = "set_no") -> DataFrame:
    """Cue numbers from 1 in stream order, image path and first statuses; a track of any size is spread over tasks."""
    return first_columns(numbered(sets, [track], [order], "cue_index"), track)


def first_columns(numbered_sets: DataFrame, track: str = "path") -> DataFrame:
    """Image path and first statuses of cues that have their number."""
    return numbered_sets.withColumns({"image_path": F.format_string("assets/cues/%s/%06d.png", F.col(track).cast("string"), F.col("cue_index")), "ocr_status": F.lit("pending"), "review_status": F.lit("unreviewed")})


def image_digest(df: DataFrame, content: str = "image") -> DataFrame:
    return df.withColumn("image_sha256", F.sha2(content, 256))


def reject_extracted(requests: DataFrame, titles: DataFrame, tracks: DataFrame, *, key: tuple[str, str, str] = ("source_id", "title_index", "stream_index")) -> DataFrame:
    """Requests with ``error``: unknown title, stream out of range, or extracted already."""
    source, title, stream = key
    known = titles.select(source, title, "pgs_tracks")
    done = tracks.select(*key).distinct().withColumn("_done", F.lit(True))
    rows = requests.join(known, [source, title], "left").join(done, list(key), "left")
    error = F.when(F.col("pgs_tracks").isNull(), "title not found").when(F.col(stream) >= F.col("pgs_tracks"), "stream not found").when(F.col("_done"), "already extracted")
    return rows.select(*requests.columns, error.alias("error"))


def attach_language(requests: DataFrame, titles: DataFrame, *, key: tuple[str, str] = ("source_id", "title_index"), stream: str = "stream_index") -> DataFrame:
    """``language`` of each stream, null if its title lists none at that place."""
    rows = requests.join(titles.select(*key, "pgs_languages"), list(key), "left")
    return rows.withColumn("language", F.get("pgs_languages", F.col(stream).cast("int"))).drop("pgs_languages")


def quarantine_failed_tracks(tracks: DataFrame, cues: DataFrame, *, track: str = "path") -> tuple[DataFrame, DataFrame]:
    """(cues of tracks without an error, failed tracks with their first error); a track without a cue fails too."""
    bad = cues.where("error is not null").groupBy(track).agg(F.min("error").alias("error"))
    empty = tracks.join(cues.select(track), track, "left_anti").select(track, F.lit("no cue in the stream").alias("error"))
    failed = bad.unionByName(empty)
    return cues.join(bad.select(track), track, "left_anti"), failed  # a track without a cue has none to lose


def estimate_total(progress: DataFrame, *, count: str = "count", duration: str = "duration_seconds", end: str = "end_ms") -> DataFrame:
    """``estimated_total``: count * duration over the seconds passed, rounded up; null in the first second."""
    elapsed = F.floor(F.col(end) / 1000).cast("bigint")
    total = F.floor((F.col(count) * F.col(duration) + F.col("_elapsed") - 1) / F.nullif(F.col("_elapsed"), F.lit(0))).cast("bigint")
    return progress.withColumn("_elapsed", elapsed).withColumn("estimated_total", total).drop("_elapsed")


def source_fingerprint(discs: DataFrame, *, titles: str = "titles", main: str = "main_title_index") -> DataFrame:
    t = F.try_element_at(F.filter(titles, lambda x: x["index"] == F.col(main)), F.lit(1))
    parts = [F.size(titles), t.playlist, t.duration_seconds, t.pgs_tracks]
    return discs.withColumn("fingerprint", F.when(t.isNotNull(), F.concat_ws(":", F.lit("bdmv"), *[p.cast("string") for p in parts])))


def available_streams(titles: DataFrame, tracks: DataFrame, *, key: tuple[str, ...] = ("source_id", "title_index"), stream: str = "stream_index") -> tuple[DataFrame, DataFrame]:
    """(every stream of each title with language and ``extracted``, the first free stream of each title, 0 if none)."""
    n = F.greatest(F.col("pgs_tracks"), F.lit(0))
    listed = titles.withColumn(stream, F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    language = F.coalesce(F.get("pgs_languages", F.col(stream)), F.lit("und")) if "pgs_languages" in titles.columns else F.lit("und")
    done = tracks.select(*key, F.col(stream).cast("int").alias(stream)).distinct().withColumn("_done", F.lit(True))
    rows = listed.withColumn("language", language).join(done, [*key, stream], "left").withColumn("extracted", F.coalesce("_done", F.lit(False))).drop("_done")
    first = titles.select(*key).join(rows.groupBy(*key).agg(F.min(F.when(~F.col("extracted"), F.col(stream))).alias("first")), list(key), "left")
    return rows, first.select(*key, F.coalesce("first", F.lit(0)).alias("first_available"))


def extract_cues(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, failed streams) of whole streams of segments."""
    sets = render_display_sets(assemble_display_sets(segments))
    in_file = F.row_number().over(Window.partitionBy("path").orderBy("set_no"))  # timing has brought a file's sets together, and images should not be written twice
    cues = image_digest(first_columns(cue_timing(sets).withColumn("cue_index", in_file)))
    broken = sets.where("error is not null and not drawn").select("path", "error")
    good, failed = quarantine_failed_tracks(segments.select("path").distinct(), cues)
    broken = broken.groupBy("path").agg(F.min("error").alias("error"))
    failed = broken.unionByName(failed.join(broken.select("path"), "path", "left_anti"))
    return good.join(failed.select("path"), "path", "left_anti"), failed
