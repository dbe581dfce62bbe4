import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from cuelake.llm import bpe, langid, mixing, queries
from test_jaccard import brute


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_stages_on_all_rows(spark, small, docs, tmp_path):
    kept, before = docs, None
    for i, (name, stage) in enumerate(P.STAGES):
        before = kept
        stage(spark, kept, small).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if i < len(P.STAGES) - 1:
            assert kept.columns == docs.columns
        if name == "language":
            judged = langid.identify(before).collect()
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged if not r.rejected} and kept.count() >= 0.9 * before.count()
        if name == "near_duplicates":
            want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "secrets":
            assert kept.count() == before.count() and kept.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
            assert kept.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()
        if name == "mixing":
            redacted = before
            n = before.count()
            assert 0.5 * n < kept.count() <= 2 * n and kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
            assert kept.groupBy("doc_id").count().where("count > 2").count() == 0
        if name == "tokens":
            assert kept.count() == before.count() and kept.where("not exact").count() == 0
            # the order of (shard, place) is that in which the mix wrote its rows: by training position
            assert kept.where("shard is null or place is null").count() == 0 and kept.select("shard", "place").distinct().count() == kept.count()
            mixed = mixing.mix(redacted, whole_rows=True)
            position = {}
            for r in mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("copies").cast("int"))))).select("doc_id", mixing.copy_position(F.col("copy")).alias("at")).orderBy("at").collect():
                position.setdefault(r.doc_id, []).append(r["at"])
            seen, times = {}, []
            for r in kept.orderBy("shard", "place").select("doc_id").collect():
                times.append(position[r.doc_id][seen.get(r.doc_id, 0)])
                seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
            assert times == sorted(times)
    with open(public_tokenizers.path(queries.TOKENIZER), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(f.read(), public_tokenizers.PATTERN).rank, special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in kept.limit(40).collect():
        assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode_ordinary(texts[r.doc_id])


def test_odd_rows_pass_every_stage(spark, small, docs):
    rows = docs.limit(30).withColumns({"size": F.lit("x"), "row": F.lit(1), "secrets": F.lit("s"), "target": F.lit(2), "score": F.lit(3)})
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the house of the and", None, None, 5), (1, "", "en", "src0", 0), (2, "token=abcdefgh " * 3, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.unionByName(odd, allowMissingColumns=True)
    rows = rows.unionByName(rows.limit(3))
    for name, stage in P.STAGES:
        for df in (rows, rows.limit(0)):
            out = stage(spark, df, small)
            n = out.count()
            assert n == 0 if df is not rows else n > 0
            if name != "tokens":
                assert out.columns == rows.columns


def test_near_duplicates_keep_versions_of_an_id(spark, small):
    """Rows of one id are documents of their own; only rows of one component are dropped, with or without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b + " x"), (None, c + " y"), (None, c), (None, a + " z"), (5, c), (8, ""), (8, ""), (8, None), (6, ""), (None, "")]
    rows += [(20, " ".join(f"v{k}_{i}" for i in range(30))) for k in range(12)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, df, small)
    assert out.columns == df.columns
    want = [(3, a), (7, b), (5, c), (8, ""), (8, None), (6, ""), (None, ""), *rows[-12:]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_run(spark, small):
    out = P.run(spark, small)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids"} and out.where("not exact").count() == 0
