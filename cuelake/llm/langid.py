"""Language identification by compression.

Each language has a zstandard dictionary of raw content: short runs of words of training texts. A text goes to the
language whose dictionary encodes it in the fewest bytes, block by block, so that a long text is
judged on all of its blocks and not on its first. Texts and dictionaries are in small letters. A narrow margin rejects the answer.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuelake.llm.workdir import bounded_batches

UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
#: Bytes of text that are encoded at once with a fresh dictionary.
BLOCK = 4096


def dictionaries(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = 900, pieces: int = 6, dictionary_bytes: int = 120_000) -> dict[str, bytes]:
    """Raw dictionary content of every non-null language in ``docs``.

    A bounded sample of labelled rows: of each language the ``texts`` first ids in the order of a
    hash. A text gives at most ``pieces`` runs of three words, those with the smallest hashes, so
    that copies give the same ones and neither a long text, a wrong label nor a passage that many
    texts share fills a dictionary. Distinct pieces are joined in the order of their hashes. They
    come to about 100 KB a language; ``dictionary_bytes``, what the compressor can look back to,
    ends a dictionary before that only where words are very long. Rows with a null id, null text, no letter or
    null language teach nothing; what reaches the driver is texts * pieces short strings a language at most.
    """
    usable = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    known = usable.where(F.col("text").rlike("\\p{L}")).select("lang", "id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"))
    # a range of hashes that holds about twice as many ids as are wanted, so that ranking them takes a few thousand rows a language at any size
    share = F.least(F.lit(1.0), F.lit(2.0 * texts + 200) / F.approx_count_distinct("id", 0.02))
    ranges = known.groupBy(F.col("lang").alias("of")).agg((share * (1 << 40)).alias("below"))
    few = known.join(F.broadcast(ranges), F.col("lang") == F.col("of")).where("h < below").select("lang", "id", "h").distinct()
    ids = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= texts)
    ids = ids.select(F.col("lang").alias("lang2"), F.col("id").alias("id2"))
    rows = usable.join(F.broadcast(ids), (F.col("id") == F.col("id2")) & (F.col("lang") == F.col("lang2")))
    words = rows.select("lang", F.filter(F.split(F.lower("text"), "\\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    runs = words.select("lang", F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(F.col("w"), i * 3 + 1, F.lit(3)), " ")).alias("runs"))
    chosen = runs.select("lang", F.explode(F.slice(F.array_sort(F.transform("runs", lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("piece")))), 1, pieces)).alias("p")).select("lang", "p.h", "p.piece").distinct()
    out: dict[str, bytes] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h, r.piece)):
        content = r.piece.encode() + b" "
        if len(out.setdefault(r.lang, b"")) + len(content) <= dictionary_bytes:
            out[r.lang] += content
    return out


def parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0)


@lru_cache(maxsize=1)
def _compressors(items: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name, content in items:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=parameters())
        out.append((name, zstandard.ZstdCompressor(compression_params=parameters(), dict_data=d)))
    return out


def judge(text: str, items: tuple[tuple[str, bytes], ...], margin: float) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected; ties go to the first language by name."""
    if not items or not text or not regex.search(r"\p{L}", text):
        return UNDETERMINED, 0.0, True
    data = text.lower().encode("utf-8", "surrogatepass")
    sizes = []
    for name, c in _compressors(items):
        sizes.append((sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)), name))
    sizes.sort()
    score = 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], score, score < margin


def predict(spark: SparkSession, learned: dict[str, bytes], text: str | Column, *, margin: float = 0.005) -> Column:
    """struct(lang_pred, score, rejected) of whole texts.

    score is the share of bytes that the best dictionary saves against the second best, 0 to 1 (1
    if only one language is known); below ``margin`` the answer is marked as rejected. Null and
    empty texts and texts without a letter are ``und`` with score 0, rejected.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(tuple(sorted(learned.items())))

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        items = shared.value
        found = [judge(t.as_py() or "", items, margin) for t in column]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["lang_pred", "score", "rejected"])

    return run((F.col(text) if isinstance(text, str) else text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4. A null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = 0.005) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and rejected (columns of these names are replaced).

    Learns from the rows that are not held out. Every row gets one result, repeated rows equal
    ones; an empty table gives an empty result.
    """
    learned = dictionaries(docs.where(~held_out(doc_id)), doc_id=doc_id, text=text, lang=lang)
    new = ("held_out", "lang_pred", "score", "rejected")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    judged = docs.select(row.alias("row"), held_out(doc_id).alias("held_out"), predict(docs.sparkSession, learned, text, margin=margin).alias("judged"))
    return judged.select("row.*", "held_out", *[F.col(f"judged.{c}") for c in new[1:]])
