"""Several edits of a line, folded in one pass, against carrying them out one after the other."""

import random

from pyspark.sql import functions as F

from cuelake.functions.text import STYLES
from cuelake.operators import editing

SPANS = "line long, ord int, type string, text string, base string, annotations array<struct<text:string,position:string>>, styles array<string>, color string"
EDITS = "line long, nth long, end_line long, sel_start long, sel_end long, kind string, style string, color_value string, annotation string, position string"


def said(span):
    return span["base"] if span["type"] == "ruby" else span["text"]


def placed(line):
    at, out = 0, []
    for s in line:
        out.append((s, at, at + len(said(s))))
        at += len(said(s))
    return out


def canonical(line):
    out = []
    for s in line:
        s = dict(s, styles=[x for x in STYLES if x in s["styles"]])
        if s["type"] == "text" and not s["text"]:
            continue
        if out and s["type"] == out[-1]["type"] == "text" and (s["styles"], s["color"]) == (out[-1]["styles"], out[-1]["color"]):
            out[-1]["text"] += s["text"]
        else:
            out.append(s)
    return out


def cut(line, start, end):
    """The line with text spans cut at both places."""
    out = []
    for s, a, b in placed(line):
        points = [a, *sorted(p for p in {start, end} if a < p < b), b] if s["type"] == "text" else [a, b]
        out += [dict(s, text=said(s)[x - a : y - a]) if s["type"] == "text" else s for x, y in zip(points, points[1:], strict=False)]
    return out


def applied(line, e):
    """(line after one edit, reason of a refusal)."""
    start, end = e["sel_start"], e["sel_end"]
    hits = lambda a, b: start < end and start < b and end > a
    if e["kind"] == "remove":
        return canonical([dict(s, type="text", text=s["base"], base=None, annotations=None) if s["type"] == "ruby" and (a, b) == (start, end) else s for s, a, b in placed(line)]), None
    if e["kind"] == "annotate":
        if e["end_line"] != e["line"]:
            return line, "several lines"
        if start >= end:
            return line, "empty"
        if any(s["type"] == "ruby" and hits(a, b) and (a, b) != (start, end) for s, a, b in placed(line)):
            return line, "cuts a ruby span"
    pieces = cut(line, start, end)
    hit = [s for s, a, b in placed(pieces) if hits(a, b)]
    if not hit:
        return canonical(pieces), None
    common = [x for x in STYLES if all(x in s["styles"] for s in hit)]
    if e["kind"] == "annotate":
        colours = {s["color"] for s in hit}
        ruby = {"type": "ruby", "text": None, "base": "".join(map(said, hit)), "annotations": [(e["annotation"], e["position"])], "styles": common, "color": colours.pop() if len(colours) == 1 else None}
        out, done = [], False
        for s, a, b in placed(pieces):
            if not hits(a, b):
                out.append(s)
            elif not done:
                out.append(ruby)
                done = True
        return canonical(out), None
    out = []
    for s, a, b in placed(pieces):
        if hits(a, b) and e["kind"] == "color":
            s = dict(s, color=e["color_value"])
        elif hits(a, b):
            rival = {"superscript": "subscript", "subscript": "superscript"}.get(e["style"])
            s = dict(s, styles=[x for x in s["styles"] if x != e["style"]] if e["style"] in common else [x for x in s["styles"] if x not in (e["style"], rival)] + [e["style"]])
        out.append(s)
    return canonical(out), None


def lines_and_edits(seed, n):
    rng = random.Random(seed)
    lines, edits = {}, []
    for line in range(n):
        spans = []
        for _ in range(rng.randint(1, 6)):
            text = "".join(rng.choice("abé漢😀") for _ in range(rng.randint(1, 5)))
            ruby = rng.random() < 0.3
            spans.append({"type": "ruby" if ruby else "text", "text": None if ruby else text, "base": text if ruby else None, "annotations": [("n", "over")] if ruby else None, "styles": rng.sample(STYLES[:5], rng.randint(0, 2)), "color": rng.choice([None, None, "#FF0000"])})
        lines[line] = spans
        borders = [a for _, a, _ in placed(spans)] + [b for _, _, b in placed(spans)]
        for nth in range(rng.randint(0, 7)):
            a, b = sorted((rng.choice(borders), rng.choice(borders))) if rng.random() < 0.6 else (rng.randint(0, 12), rng.randint(0, 25))
            edits.append({"line": line, "nth": nth, "end_line": line + (rng.random() < 0.05), "sel_start": a, "sel_end": b, "kind": rng.choice(["style", "style", "color", "annotate", "annotate", "remove"]), "style": rng.choice(STYLES), "color_value": rng.choice([None, "#00FF00"]), "annotation": f"note {nth}", "position": "over"})
    return lines, edits


def test_random_edit_lists(spark):
    lines, edits = lines_and_edits(4, 400)
    want, refusals = {}, set()
    for line, spans in lines.items():
        now = canonical(spans)
        for e in sorted((e for e in edits if e["line"] == line), key=lambda e: e["nth"]):
            now, reason = applied(now, e)
            if reason:
                refusals.add((line, e["nth"], reason))
        want[line] = [(s["type"], said(s), s["styles"], s["color"], s["annotations"] if s["type"] == "ruby" else None) for s in now]
    df = spark.createDataFrame([(line, i, s["type"], s["text"], s["base"], s["annotations"], s["styles"], s["color"]) for line, spans in lines.items() for i, s in enumerate(spans)], SPANS)
    told = spark.createDataFrame([tuple(e.values()) for e in edits], EDITS)
    unknown = spark.createDataFrame([(-1, 0, -1, 0, 4, "annotate", None, None, "x", "over"), (-1, 1, -1, 0, 4, "style", "bold", None, None, None)], EDITS)
    done, refused = editing.edit_lines(df, told.unionByName(unknown))
    got = {}
    for r in done.orderBy("line", "ord").collect():
        got.setdefault(r.line, []).append((r.type, r.text if r.type == "text" else r.base, r.styles, r.color, [tuple(a) for a in r.annotations] if r.type == "ruby" else None))
    assert got == want
    assert {tuple(r) for r in refused.collect()} == refusals | {(-1, 0, "no such line")}
    assert len({r for _, _, r in refusals}) == 3 and sum(len(v) for v in want.values()) > 800


def test_edits_are_one_pass(spark, tmp_path):
    """Two scans and three exchanges, however many edits a line has; no Python."""
    lines, edits = lines_and_edits(5, 5)
    spark.createDataFrame([(line, i, s["type"], s["text"], s["base"], s["annotations"], s["styles"], s["color"]) for line, spans in lines.items() for i, s in enumerate(spans)], SPANS).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([tuple(e.values()) for e in edits], EDITS).write.parquet(str(tmp_path / "e"))
    done, refused = editing.edit_lines(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "e")))
    for df in (done, refused):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Exchange") <= 3 and "Python" not in plan
    assert editing.edit_lines(spark.read.parquet(str(tmp_path / "s")).limit(0), spark.read.parquet(str(tmp_path / "e")).limit(0))[0].where(F.lit(True)).count() == 0
