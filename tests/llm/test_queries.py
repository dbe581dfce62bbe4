"""The registered corpus queries against DuckDB, or against plain loops where SQL can't express them."""

import glob
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard

from cuelake.llm import langid, quality, queries, urlfilter


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    cursor = c.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns

    def row(values):
        return tuple(float(f"{v:.9e}") if isinstance(v, float) else v for v in values)

    ours = sorted(repr(row(r[c] for c in columns)) for r in df.collect())
    assert ours == sorted(repr(row(r[names.index(c)] for c in columns)) for r in cursor.fetchall())


def spark_hash(value):
    return xxhash.xxh64(value if isinstance(value, bytes) else value.to_bytes(8, "little", signed=True), seed=42).intdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_language_by_loops(spark, small):
    """Dictionaries and sizes made again from the definition, with fresh compressors, give every answer of the query."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    taught = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and re.search(r"[^\W\d_]", r.text or "")]
    learned = {}
    for lang in sorted({r.lang for r in taught}):
        own = sorted((r for r in taught if r.lang == lang), key=lambda r: (signed(spark_hash(r.doc_id)) % (1 << 40), r.doc_id))[:900]
        pieces = set()
        for r in own:
            words = r.text.lower().split()
            runs = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)]
            pieces |= set(sorted((signed(spark_hash(x.encode())), x) for x in runs)[:6])
        learned[lang] = b"".join(x.encode() + b" " for _, x in sorted(pieces))
    assert max(map(len, learned.values())) < 120_000
    found = {r.doc_id: r for r in queries.op4_language_id(spark, small).collect()}
    parameters = langid.parameters()
    for r in rows[:150]:
        data = (r.text or "").lower().encode()
        sizes = sorted((sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), lang) for lang, d in learned.items())
        want = sizes[0][1] if re.search(r"[^\W\d_]", r.text or "") else "und"
        got = found[r.doc_id]
        assert got.lang_pred == want and (want == "und" or math.isclose(got.score, 1 - sizes[0][0] / sizes[1][0]))
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_slopes_are_derivatives():
    rng = np.random.default_rng(3)
    theta, score, y = np.array([-np.inf, -0.7, 0.4, 1.9, np.inf]), rng.normal(size=40), rng.integers(0, 4, 40)
    _, d_score, d_low, d_high = quality.slopes(score, y, theta)
    loss = lambda s, t: -np.log(quality.slopes(s, y, t)[0])
    e = 1e-6
    assert np.allclose((loss(score + e, theta) - loss(score - e, theta)) / (2 * e), d_score, atol=1e-5)
    for k in (1, 2, 3):
        up, down = theta.copy(), theta.copy()
        up[k] += e
        down[k] -= e
        assert np.allclose((loss(score, up) - loss(score, down)) / (2 * e), np.where(y == k, d_low, 0) - np.where(y + 1 == k, d_high, 0), atol=1e-5)


def test_quality_query_by_loops(spark, small):
    """The query's grades from its model by a plain loop over features."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    ratings = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    model = quality.train(docs, ratings)
    found = {r.doc_id: r for r in queries.op1_ordinal_quality(spark, small).collect()}
    import pyarrow as pa

    for r in docs.limit(80).collect():
        places, _ = quality.features(pa.array([r.text], pa.string()))
        score = sum(float(model.weights[p]) for p in places)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds] if len(places) else [0.0, 0.0]
        got = found[r.doc_id]
        assert math.isclose(got.expected_grade, sum(tails), rel_tol=1e-4, abs_tol=1e-6) and math.isclose(got.tail_probability, tails[1], rel_tol=1e-4, abs_tol=1e-6) and got.kept == (got.tail_probability >= 0.6)


def test_url_query_by_loops(spark, small):
    found = {r.page_id: r for r in queries.op7_url_filter(spark, small).collect()}
    for page in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect():
        rest = page.url.split("://", 1)[1] if "://" in (page.url or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(d + p), d + p, v) for v, d, p in urlfilter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        got = found[page.page_id]
        assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_long_redirect_chains(spark):
    """Chains and cycles of redirects from one page to the next: a block at either end reaches all, rules that allow stand."""
    n = 40
    pages = [(i, f"http://h{i % 7}.com/{i}", f'<link rel="canonical" href="http://h{(i + 1) % 7}.com/{i + 1}">') for i in range(n)] + [(n, f"http://h{n % 7}.com/{n}", None)]
    pages += [(100 + i, f"http://w{i}.org/{'fr' if i == 3 else 'x'}/{i}", f'<meta http-equiv="refresh" content="0; url=http://w{(i + 1) % 9}.org/{"fr" if (i + 1) % 9 == 3 else "x"}/{(i + 1) % 9}">') for i in range(9)]
    hops = spark.createDataFrame([(f"http://h{n % 7}.com/{n}", "http://bad.net/1"), ("http://w5.org/x/5", "http://bad.net/2"), (None, "http://bad.net/3"), ("http://h0.com/none", None)], "source_url string, target_url string")
    out = {r.page_id: r.verdict for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=hops).collect()}
    assert {i for i, v in out.items() if v == "allow"} == {103}


def test_further_columns_stay(spark):
    """Columns of the caller with the names of helpers go through unharmed."""
    from pyspark.sql import functions as F

    from cuelake.llm import secrets

    names = ["_text", "_key", "_hit", "_judged", "_kept", "_nth", "_p", "row", "judged", "candidate", "text2", "key", "n", "digest"]
    df = spark.createDataFrame([(1, "the secret: 'abcdefgh' is here", "en")], "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in names})
    for out in (secrets.scan(df), langid.identify(df), quality.grade_documents(df, df.select("doc_id", F.lit(1).alias("grade")))):
        assert list(out.select(*names).first()) == [f"own {c}" for c in names]
