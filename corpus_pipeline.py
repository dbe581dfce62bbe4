"""A training corpus from ``documents``: language, near duplicates, secrets, mixing, tokens.

Each stage takes all that the one before kept and returns the columns of its input; the last
returns token ids. Every stage is defined for nulls in any column, empty and very long texts,
repeated rows, further columns and empty tables, as its operator is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bitmap, bpe, jaccard, langid, mixing, secrets
from cuelake.llm.queries import TOKENIZER, table
from cuelake.llm.workdir import Scratch


def packed(docs: DataFrame) -> Column:
    """A row as one struct, so that no column of it can clash with those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without a letter or with a narrow margin go."""
    learned = langid.dictionaries(docs.where(~langid.held_out()))
    judged = docs.select(packed(docs), langid.predict(spark, learned, "text").alias("judged"))
    return judged.where(~F.col("judged.rejected")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at five-word shingles and a similarity of 0.8: that with the smallest id.

    Every row is compared under a 128-bit digest of its id and text: rows of one id with unlike texts
    are documents each, and rows without an id are compared like others (they come after those
    with one). Of equal ids in a component the text with the smallest digest stays, and of equal
    rows one. Rows without a word are copies only if id and text are equal. Rows that a bitmap of
    hashes shows to be alone in their component stay where they are; only the others are shuffled.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), ":").otherwise(F.concat(F.lit(":="), "text")))))
    with Scratch(spark, "near") as scratch:
        found = jaccard.jaccard_components(docs.select(key.alias("row_key"), "text"), doc_id="row_key", words=5, num=4, den=5)
        found = found.groupBy(F.col("doc_id").alias("row_key")).agg(F.max("n_shingles").alias("size"), F.min("component_id").alias("component"))
        each = docs.groupBy(key.alias("row_key")).agg(F.first("doc_id").alias("id"), F.min(F.md5("text")).alias("digest"), F.count(F.lit(1)).alias("copies"))
        group = F.struct(F.col("size") == 0, F.when(F.col("size") == 0, F.col("row_key")).otherwise(F.col("component"))).alias("group")
        each = scratch.save(each.join(found, "row_key").select("row_key", group, "id", "digest", "copies"), "each")
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "row_key")).getField("row_key").alias("stays")
        groups = scratch.save(each.groupBy("group").agg(first, F.sum("copies").alias("members")).where("members > 1").select("group", "stays"), "groups")
        shared = scratch.save(each.join(groups, "group").select("row_key", (F.col("row_key") == F.col("stays")).alias("stays")), "shared")
        rows = bitmap.flagged(docs.select(packed(docs), key.alias("row_key")), shared, F.xxhash64("row_key"), bitmap.buckets_for(shared.count()), "together")
        one = rows.where("together").join(shared, "row_key", "left").where("coalesce(stays, true)").groupBy("row_key").agg(F.first("row").alias("row"))
        return scratch.keep(rows.where("not together").select("row.*").unionByName(one.select("row.*")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by their kind; n_chars follows the text."""
    columns = docs.columns
    found = secrets.scan(docs.select("doc_id", "text", packed(docs))).withColumn("_clean", secrets.redacted(F.col("text"), F.col("secrets")))
    changed = F.size("secrets") > 0
    out = {"text": F.when(changed, F.col("_clean")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, sorted by training position: files by name, rows by their place in a file.

    A document that the mix takes in part at the end of its source's target is taken whole if half
    of it or more is.
    """
    mixed = mixing.mix(docs, whole_rows=True)
    copies = (F.col("copies") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    rows = mixed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.withColumn("at", mixing.copy_position(F.col("copy"))).orderBy("at", "doc_id").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact, shard, place): ids are little-endian 32-bit integers, exact tells whether they decode to the text.

    shard is the number of the file that the mixing stage wrote the row to and place the row's place in
    it: the training order is that of (shard, place). Both are null if ``docs`` is not read from files.
    """
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    shard, place = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1), F.col("_metadata.row_index")
    try:
        docs.select(shard, place)
    except AnalysisException:  # only a scan of files has these hidden columns
        shard, place = F.lit(None).cast("string"), F.lit(None).cast("long")
    coded = docs.select(F.struct("doc_id", "lang", "source", "text", shard.alias("shard"), place.alias("place")).alias("row"), tokenizer.code("text").alias("coded"))
    exact = F.col("coded.decoded") == F.coalesce("row.text", F.lit("")).cast("binary")
    return coded.select("row.doc_id", "row.lang", "row.source", (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"), "coded.ids", exact.alias("exact"), "row.shard", "row.place")


STAGES = [("language", keep_identified), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("tokens", tokenize)]
#: Components, compression and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again before the next."""
    with Scratch(spark, "pipeline") as scratch:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
