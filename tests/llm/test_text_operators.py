import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cuelake.llm import langid, mixing, quality, queries, secrets, trigrams

ASSIGN = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def secret_texts():
    rng = random.Random(2)
    words = ["password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", "\"", "'", "abcdefgh", "abc", "AKIA", "0123456789abcdef01234567", "ABCDEFGHIJKLMNOP", "\n", "é漢", "ſecret", "K", "-", "_"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    return texts + ["secret=token:abcdefgh", "token==abcde", "", "𠮷 password = '" + "x" * 9 + "'", "a" * 24, "AKIAAKIA" + "A" * 11, "AKIA" * 5 + " token=" + "z" * 50_000, "ghp_" + "a1" * 18 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY-----"]


def test_secrets_against_brute_force(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, secrets string").repartition(4)
    out = {r.doc_id: r.secrets for r in secrets.scan(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in out[i] if s.base] == base_spans(t)
    assert {s.kind for s in out[len(texts) - 1]} >= {"github", "slack", "private_key"}


def test_secret_edges(spark):
    df = spark.createDataFrame([(None, "token=abcdef"), (None, None), (1, None), (1, "secret: 'abcdefg'"), (1, "secret: 'abcdefg'"), (2, "")], "doc_id long, text string")
    assert sorted(len(r.secrets) for r in secrets.scan(df).collect()) == [0, 0, 0, 1, 1, 1]
    assert secrets.scan(df.limit(0)).count() == 0
    clean = secrets.scan(df).select("text", secrets.redacted(F.col("text"), F.col("secrets")).alias("c")).where("text like 'secret%'").first().c
    assert clean == "[assign]'"
    plan = secrets.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_follow_from_the_expressions():
    found = {r.kind: sorted(sorted(p) for p in r.query()) for r in secrets.RULES}
    assert found["hex"] == [] and found["access"] == [["aki", "kia"]]
    assert ["ken", "oke", "tok"] in found["assign"] and len(found["assign"]) == 6
    assert trigrams.query_of("ab(c|[de])f+x?") == frozenset(frozenset(("ab" + c, f"b{c}f")) for c in "cde") and trigrams.query_of("ab|cdef") == frozenset()


def test_trigram_queries_never_lose_a_match():
    for rule in secrets.RULES:
        for t in secret_texts():
            if re.search(rule.regex.replace("\\x20", " "), t):
                assert trigrams.fits("".join(c.lower() if c.isascii() else c for c in t), rule.query())
    rng = random.Random(1)

    def expression(depth):
        k = rng.random()
        if depth == 0 or k < 0.35:
            return "".join(rng.choice("abAB-x") for _ in range(rng.randint(1, 4)))
        if k < 0.45:
            return rng.choice(["[ab]", "[a-c]", "[^a]", "[abxA]", ".", "\\b"])
        if k < 0.6:
            return f"(?:{expression(depth - 1)}|{expression(depth - 1)})"
        if k < 0.75:
            return f"(?:{expression(depth - 1)})" + rng.choice(["?", "*", "+", "{2}", "{1,3}", "{2,}", "+?"])
        return expression(depth - 1) + expression(depth - 1)

    ruled_out = matched = 0
    for _ in range(1500):
        e = expression(4)
        query, compiled = trigrams.query_of(e), re.compile(e)
        for _ in range(40):
            t = "".join(rng.choice("abABcx-") for _ in range(rng.randint(1, 14)))
            may = trigrams.fits(t.lower(), query)
            assert may or not compiled.search(t)
            matched, ruled_out = matched + bool(compiled.search(t)), ruled_out + (not may)
    assert matched > 5000 and ruled_out > 5000


def test_postings_intersect(spark):
    rows = [(1, "xabcdx"), (2, "ABC"), (3, "bcd"), (None, "abc"), (None, "bcd"), (4, None), (5, "xyz ABCD"), (6, "uvw")]
    df = spark.createDataFrame(rows, "key long, text string")
    queries = [frozenset([frozenset(["abc", "bcd"]), frozenset(["uvw"])]), frozenset()]
    found = secrets.candidates(secrets.index(df, "key", "text", trigrams.named(queries)), queries)
    assert sorted((r.key for r in found.collect()), key=repr) == [1, 5, 6, None]  # rows without an id are one document here


def test_secret_query(spark, small):
    out = {r.doc_id: r for r in queries.op3_secret_scan(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        want = base_spans(r.text or "")
        assert out[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (out[r.doc_id].n_assign, out[r.doc_id].n_hex) == (sum(k == "assign" for k, _, _ in want), sum(k == "hex" for k, _, _ in want))


def test_language(spark, small):
    out = queries.op4_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_edges(spark):
    rows = [(i, f"le chat noir mange la souris grise numero {i} dans la maison", "fr") for i in range(30)] + [(100 + i, f"the black cat eats the grey mouse number {i} in the house", "en") for i in range(30)]
    rows += [(500, None, "fr"), (501, "", None), (502, "123 !!", "en"), (None, "the black cat eats in the house", None), (503, "le chat mange la souris " * 4000, None), (503, "le chat mange la souris " * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.identify(df)
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert (got[500], got[501], got[502], got[None], got[503]) == ("und", "und", "und", "en", "fr") and out.count() == len(rows)
    assert all(got[i] == ("fr" if i < 100 else "en") for i in got if i is not None and i < 200)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    # held-out rows teach nothing
    assert "zz" not in langid.dictionaries(df.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang"))).where(~langid.held_out()))


def water(sizes, weights, share, most):
    target, open_, left = {}, dict(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weights[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 50]))), rng.choice(["a"] * 9 + ["b", "c", "é", None]), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in names}
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    for s in names:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1 and all(0 <= r.taken <= 2 * r.size for r in own)
        for r in own:
            assert r.taken == r.copies * r.size + r.part and (r.position is None) == (r.taken == 0)
            if r.taken:  # the demand up to a position is the words before it
                t, a, b = r.position, r.begin, r.finish
                assert abs((a * t + (b - a) * t * t / 2) / ((a + b) / 2) * r.target - r.words_before) < 1e-6 * (1 + r.target)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", None), (None, "x y", None), (2, "", ""), (3, "q " * 50000, "b")], "doc_id long, text string, source string")
    out = mixing.mix(df, whole_rows=True).collect()
    assert len(out) == 6 and sum(r.size for r in out) == 50004 and {r.row.doc_id for r in out} == {1, 2, 3, None}
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.where("doc_id = 1")).collect())


def rated(n):
    rng, good, bad, vile = random.Random(4), [f"word{i}" for i in range(300)], [f"SPAM{i}!!" for i in range(60)], ["grot", "scumm", "idjot"]
    docs, grades = [], []
    for i in range(n):
        g = i % 3
        words = [rng.choice(good) for _ in range(rng.randint(30, 120))]
        if g == 1:
            words = [rng.choice(bad) for _ in words]
        if g == 0:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(vile))
        docs.append((i, " ".join(words), "k"))
        grades.append((i, g))
    return docs, grades


def test_quality(spark):
    docs, grades = rated(2400)
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    known = spark.createDataFrame(grades, "doc_id long, grade int").where("doc_id < 2100")
    out = {r.doc_id: r for r in quality.grade_documents(df, known).collect()}
    held = [(out[i], g) for i, g in grades if i >= 2100]
    assert sum((r.tail_probability >= 0.5) == (g == 2) for r, g in held) >= 0.9 * len(held)
    mean = [sum(r.expected_grade for r, g in held if g == k) / 100 for k in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]


def test_quality_edges(spark):
    docs, grades = rated(90)
    rows = [*docs, (500, None, "k"), (501, "", "k"), (502, "!!! ...", "k"), (None, "word1", "k"), (7, docs[7][1], "k"), (503, "word1 " * 80000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    known = spark.createDataFrame([*grades, (8, None), (9, 77), (None, 1), (500, 2)], "doc_id long, grade int")
    out = quality.grade_documents(df, known).collect()
    assert len(out) == len(rows) and [(r.expected_grade, r.kept) for r in out if r.doc_id in (500, 501, 502)] == [(0.0, False)] * 3
    assert len({r.expected_grade for r in out if r.doc_id == 7}) == 1
    assert quality.grade_documents(df.limit(0), known).count() == 0 and quality.grade_documents(df, known.limit(0)).count() == len(rows)


def test_thresholds_rise_and_tails_fall():
    import numpy as np

    rng = np.random.default_rng(0)
    places = [np.unique(rng.integers(0, 1000, 20)) for _ in range(300)]
    model = quality.fit(places, rng.integers(0, 4, 300), grades_count=4)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.tails(np.concatenate(places), np.concatenate(([0], np.cumsum([len(x) for x in places]))))
    assert (np.diff(p, axis=1) <= 0).all()


@pytest.mark.parametrize("text", ["Éa  b\tB", "", "a\u00a0b c", "x" * 5000])
def test_word_bounds(text):
    import pyarrow as pa

    from cuelake.llm import textvec as V

    data, offsets = V.utf8(pa.array(["z", text, None, text]))
    start, end, row = V.word_bounds(data, offsets)
    got = [bytes(data[a:b]) for a, b, r in zip(start, end, row, strict=True) if r == 1]
    assert got == re.findall(rb"[^\x20\x09-\x0D]+", text.encode()) == [bytes(data[a:b]) for a, b, r in zip(start, end, row, strict=True) if r == 3]
    h = V.span_hashes(data, start, end)
    assert (h[row == 1] == h[row == 3]).all()


def test_very_many_secrets_in_one_text(spark):
    """A hundred thousand secrets in a text are found and redacted in seconds, not by the square of their number."""
    import time

    from pyspark.sql import functions as F

    text = "é token=abcdef " * 100_000
    df = spark.createDataFrame([(1, text), (2, "token=abcdef")], "doc_id long, text string")
    secrets.scan(df.where("doc_id = 2")).select(secrets.redacted(F.col("text"), F.col("secrets"))).collect()
    began = time.time()
    row = secrets.scan(df).select("doc_id", "secrets", secrets.redacted(F.col("text"), F.col("secrets")).alias("clean")).where("doc_id = 1").first()
    assert time.time() - began < 40
    assert [(s.start, s.end) for s in row.secrets] == [(15 * i + 2, 15 * i + 14) for i in range(100_000)] and row.clean == "é [assign] " * 100_000
