"""Groups of spelling variants by pivotal grams.

A word's bigrams are ranked by how many words have them, rarest first. Its prefix is the first
three; two of them that share no letter are its pivots, chosen by dynamic programming over their
places for the shortest lists. One edit spoils one pivot at most, and of two words that are one
edit apart, one word's unspoilt pivot is in the other's prefix: otherwise each word's prefix would
reach further down the ranking than the other's (Deng, Li and Feng, 2014).

The limits of place are exact ones. The edit is on one side of the unspoilt pivot, so that the
words agree from the pivot to the end of its other side: they have that stretch of letters in
common, counted from the start or from the end. An entry of the index is a prefix gram's stretch
to the left or to the right with the word's length; a pivot asks for its own stretches with the
three lengths that one edit allows. Of the two pivots only two stretches are needed: an edit that
is not to the right of the first pivot is to the left of the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.workdir import Scratch

RUN, UPPER, LOWER = "[A-Za-z\\u00C0-\\u00FF]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Grams of a prefix, two for the edit and one: words need four letters. A gram that repeats within a word is kept at its first five places: a pivot is one of its first three, and an edit makes two grams at most.
PREFIX, PLACES = 3, 5
LEFT, RIGHT = b"<", b">"


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spoil_every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): distinct words of all texts and how often they occur.

    A word is a maximal run of letters of Latin-1 with A to Z in lower case; where ``spoil_every``
    divides the crc32 of ``<doc_id>:<word>``, it loses the letter at crc32 modulo its length. Words
    shorter than ``least_length`` afterwards or with fewer than ``least_count`` occurrences are left
    out. Null and empty texts have none, a null id counts as empty text, repeated rows count each.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))  # shorter runs make no word
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.transform(runs, lambda r: F.translate(r, UPPER, LOWER))).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    cut = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % spoil_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words have each bigram. Words are of 90 letters, so that there are 8,100 at most."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    return dict(words.where(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").count().collect())


def ranked_prefix(word: str, count: dict[str, int]) -> list[tuple[int, str, int]]:
    """(count, gram, place) of the prefix, rarest first; grams equal to the third come along."""
    ranked = sorted((count.get(word[i : i + 2], 0), word[i : i + 2], i) for i in range(len(word) - 1))
    return ranked[:PREFIX] + [g for g in ranked[PREFIX : PREFIX + PLACES - 1] if g[1] == ranked[PREFIX - 1][1]]


def pivots(prefix: list[tuple[int, str, int]], wanted: int = 2) -> list[int]:
    """Places of ``wanted`` grams of the prefix that share no letter, with the least sum of counts.

    best[k] is the best choice of k grams among those seen so far, by place: a gram joins the best
    choice of one gram less that ends two places before it or earlier.
    """
    grams = sorted((place, n) for n, _, place in prefix[:PREFIX])
    none = (math.inf, ())
    history: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ()), *[none] * wanted]]
    for i, (place, n) in enumerate(grams):
        free = max(j for j in range(i + 1) if j == 0 or grams[j - 1][0] <= place - 2)
        row = [(0, ())]
        for k in range(1, wanted + 1):
            cost, chosen = history[free][k - 1]
            row.append(min(history[i][k], (cost + n, (*chosen, place))))
        history.append(row)
    return list(history[-1][wanted][1])


def stretch(side: bytes, length: int, letters: str) -> int:
    return xxhash.xxh64_intdigest(side + b"%d:" % length + letters.encode()) - (1 << 63)


def entries(word: str, count: dict[str, int]) -> tuple[list[int], list[int]]:
    """What the index has of a word, and what the word asks it for."""
    prefix, n = ranked_prefix(word, count), len(word)
    kept = [stretch(LEFT, n, word[: at + 2]) for _, _, at in prefix] + [stretch(RIGHT, n, word[at:]) for _, _, at in prefix]
    first, second = pivots(prefix)
    asked = [stretch(side, m, letters) for side, letters in ((LEFT, word[: first + 2]), (RIGHT, word[second:])) for m in (n - 1, n, n + 1)]
    return list(dict.fromkeys(kept)), list(dict.fromkeys(asked))


def near_words(words: DataFrame, count: dict[str, int]) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words that one inserted, deleted or replaced letter sets apart; a < b, each once.

    ``words`` has (word, n) with words of four letters or more, distinct and without nulls.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            both = [entries(word, count) for word in names]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([k for k, _ in both], pa.list_(pa.int64())), pa.array([a for _, a in both], pa.list_(pa.int64()))], ["word", "n", "kept", "asked"])

    listed = words.select("word", "n").mapInArrow(index, "word string, n long, kept array<long>, asked array<long>")
    kept = listed.select(F.explode("kept").alias("stretch"), F.col("word").alias("w"), F.col("n").alias("m"))
    asked = listed.select(F.explode("asked").alias("stretch"), "word", "n")
    met = kept.join(asked, "stretch").where((F.col("w") != F.col("word")) & (F.abs(F.length("w") - F.length("word")) <= 1) & (F.levenshtein("w", "word", 1) == 1))
    ordered = F.when(F.col("w") < F.col("word"), F.struct(F.col("w").alias("a"), F.col("m").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))).otherwise(F.struct(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("w").alias("b"), F.col("m").alias("n_b")))
    return met.select(ordered.alias("pair")).select("pair.*").distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form): the end of each chain of forms, by doubling steps.

    Chains must have no cycle. The rounds are the logarithm of the longest chain.
    """
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        step = scratch.save(now.join(further, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def largest(word: Column, n: Column) -> Column:
    """An aggregate: the struct (n, word) of largest n, of equal ones the word first in code-point order."""
    return F.min(F.struct((-n).alias("less"), word.alias("word")))


def spelling_groups(words: DataFrame, *, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n).

    Near words are one edit apart. The form is the near word of largest n (ties: the first in
    code-point order) where that is ``times`` n or more, else null; the root is where the forms
    lead, the word itself if it has none. As n rises along forms, they make no cycle. Words must be
    distinct, of four letters or more and without nulls; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a form has to be more frequent than the word")
    spark = words.sparkSession
    with Scratch(spark, "spelling") as scratch:
        words = scratch.save(words.select("word", "n"), "words")
        pairs = scratch.save(near_words(words, gram_counts(words)), "pairs")
        sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
        near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), largest(F.col("near"), F.col("near_n")).alias("best"))
        judged = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
        judged = scratch.save(judged.select("word", F.when(F.col("fits"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "judged")
        ends = roots(judged.where(F.col("form").isNotNull()), scratch)
        found = judged.join(ends, "word", "left")
        return scratch.keep(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
