"""Properties against short Python models."""

import html

from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.functions import text as X
from cuelake.operators import editing
from cuelake.operators import layout as L


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60)), max_size=40), st.integers(0, 8))
def test_gap_cluster(spark, rows, gap):
    df = spark.createDataFrame(rows, "g long, p long")
    got = sorted((r.g, r.start, r.end) for r in L.gap_cluster(df, by="g", position="p", max_gap=gap).collect())
    want = []
    for g in sorted({g for g, _ in rows}):
        bands = []
        for p in sorted({p for h, p in rows if h == g}):
            if bands and p - bands[-1][1] <= gap:
                bands[-1][1] = p + 1
            else:
                bands.append([p, p + 1])
        want += [(g, a, b) for a, b in bands]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "ruby"]), st.sampled_from(["", "a", "bc"]), st.sampled_from([(), ("bold",), ("italic", "bold")])), max_size=12))
def test_coalesce(spark, rows):
    df = spark.createDataFrame([(1, i, t, x, x, list(s)) for i, (t, x, s) in enumerate(rows)], "line long, ord int, type string, text string, base string, styles array<string>")
    got = [(r.type, r.text if r.type == "text" else r.base, tuple(r.styles)) for r in editing.coalesce_spans(df).orderBy("ord").collect()]
    want = []
    for t, x, s in rows:
        s = tuple(y for y in X.STYLES if y in s)
        if t == "text" and want and want[-1][0] == "text" and want[-1][2] == s:
            want[-1] = ("text", want[-1][1] + x, s)
        elif t == "ruby" or x:
            want.append((t, x, s))
    assert got == [w for w in want if w[0] == "ruby" or w[1]]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="<>&ab字 \"'", max_size=20))
def test_escape(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.srt_escape(F.col("t"))).first()[0] == html.escape(text, quote=False)
