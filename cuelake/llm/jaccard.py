"""Similarity self-join of documents on word shingles: a size-aware heavy-light join.

Exact for every Jaccard threshold num/den. Equal sets form a class first, so copies never
meet as pairs. Of the classes,

* *light* (small) sets enumerate their fixed-size subsets: two sets of a and b >= a elements
  that link have at least ``c(b) = ceil(num * b / den)`` elements in common, so they share a
  subset of just that size;
* *heavy* (large) sets scan inverted lists of single shingles. A set misses at most
  ``d = floor((den - num) * n / den)`` of its elements in a partner, so of its first d + k
  shingles in hash order k are in the partner's first ones too; sets with fewer shared ones
  leave at once. For the rest the lists are built over the d + 1 rarest shingles, with the
  position filter.

The boundary between the two is the size at which the estimated number of keys is least.
No list is expanded into all its pairs: each member meets the list's centre first; verified
links give components, and only members of different components meet after that, block by block
inside tasks, where sizes, positions and parity bitmaps (a lower bound of how many elements two
sets do not share) leave few pairs to verify.

Elements are 64-bit hashes of shingles; two of 10**4 elements that collide by chance are a matter
of 10**-12 for a pair. A set is known by a 128-bit digest of its elements.
"""

from __future__ import annotations

import hashlib
import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm import bitmap
from cuelake.llm import textvec as V
from cuelake.llm.blocks import across, in_blocks, pairs_at, where, whole_parts
from cuelake.llm.components import connected_components
from cuelake.llm.workdir import Scratch, bounded_batches

#: Sizes for which subset enumeration is considered at all.
LARGEST_LIGHT = 40
#: Bits of a set's parity bitmap, and members of a list that meet in one task at most (twice as many if of two blocks).
PARITY_BITS, BLOCK_ROWS = 512, 1024


def missing(n: int, num: int, den: int) -> int:
    """How many elements of a set of n can be absent from a linked set."""
    return (den - num) * n // den


def common(n: int, num: int, den: int) -> int:
    """How many elements a set of n, the larger of two, shares with a linked set at least."""
    return -(-num * n // den)


def extra(n: int, num: int, den: int) -> int:
    return missing(n, num, den) // 2 + 1


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a set of n enumerates: one for each size of a larger partner."""
    return sorted({c for b in range(n, den * n // num + 1) if (c := common(b, num, den)) <= n})


def light_cost(n: int, num: int, den: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, num, den))


def heavy_cost(n: int, num: int, den: int) -> int:
    return missing(n, num, den) + extra(n, num, den) + n


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Sets smaller than the result are light; it minimises the keys over the histogram ``sizes``."""
    small = {n: k for n, k in sizes.items() if n <= LARGEST_LIGHT}

    def cost(x: int) -> int:
        return sum(k * light_cost(n, num, den) for n, k in small.items() if n < x) + sum(k * heavy_cost(n, num, den) for n, k in small.items() if n >= common(x, num, den))

    return min(range(1, LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def shingle_sets(batch: pa.RecordBatch, text: str, words: int):
    """Each slice of a batch with the sorted distinct shingle hashes of its rows and their offsets."""
    for part in V.slices(batch, text):
        data, offsets = V.utf8(part.column(text))
        data = V.lower_ascii(data)
        start, end, row = V.word_bounds(data, offsets)
        h, at = V.shingle_hashes(V.span_hashes(data, start, end), row, part.num_rows, words)
        yield part, *V.distinct_by_row(h, at, part.num_rows)


def digests(h: np.ndarray, o: np.ndarray) -> list[bytes]:
    return [hashlib.md5(h[i:j].tobytes()).digest() for i, j in itertools.pairwise(o)]


def first_half(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def subset_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A key for each enumerated subset: the sum of its mixed elements, mixed with its size."""
    v = V.mix(hashes)
    out = []
    with np.errstate(over="ignore"):
        total = v.sum(dtype=np.uint64)
        for c in subset_sizes(len(v), num, den):
            gone = list(itertools.combinations(range(len(v)), len(v) - c))
            left = total - v[np.array(gone, np.int64).reshape(len(gone), -1)].sum(axis=1, dtype=np.uint64)
            out.append(V.mix(left + np.uint64(c) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def id_type(docs: DataFrame, doc_id: str) -> str:
    return "binary" if dict(docs.dtypes)[doc_id] == "binary" else "long"


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast(id_type(docs, doc_id)).alias("id"), F.col(text).cast("string").alias("text"))


def sized(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, n, digest, s): the size and the digest of each row's set, and the digest's first half."""

    def run(batches):
        for batch in batches:
            for part, h, o in shingle_sets(batch, "text", words):
                keys = digests(h, o)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(o), pa.int64()), pa.array(keys, pa.binary()), pa.array(first_half(keys))], ["id", "n", "digest", "s"])

    return identified(docs, doc_id, text).mapInArrow(run, f"id {id_type(docs, doc_id)}, n long, digest binary, s long")


def postings(docs: DataFrame, text: str, words: int, num: int, den: int, x: int) -> DataFrame:
    """(key, s, n, light): subset keys of light sets, the first d + k shingles of heavy ones.

    s is the first half of the digest. It only narrows the search: two sets of one s would be missed
    here if no third set held one of their keys, 2**-64 for a linked pair.
    """

    def run(batches):
        for batch in batches:
            for part, h, o in shingle_sets(batch, "text", words):
                n = np.diff(o)
                s = first_half(digests(h, o))
                d = (den - num) * n // den
                take = np.where(n >= common(x, num, den), np.minimum(n, d + d // 2 + 1), 0)
                rows = np.repeat(np.arange(part.num_rows), take)
                at = np.repeat(o[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(s[rows]), pa.array(n[rows]), pa.array(np.zeros(len(rows), bool))], ["key", "s", "n", "light"])
                small = np.flatnonzero((n > 0) & (n < x))
                keys = [subset_keys(h[o[i] : o[i + 1]], num, den) for i in small]
                if keys:
                    rows = np.repeat(small, [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(s[rows]), pa.array(n[rows]), pa.array(np.ones(len(rows), bool))], ["key", "s", "n", "light"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, s long, n long, light boolean")


def parity(h: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """PARITY_BITS bits of each row's elements: a bit is set if an odd number of them falls on it.

    Two rows differ in no more bits than there are elements in one and not the other.
    """
    place = at * PARITY_BITS + (h >> np.uint64(20)).astype(np.int64) % PARITY_BITS
    return np.packbits((np.bincount(place, minlength=rows * PARITY_BITS) & 1).astype(bool).reshape(rows, PARITY_BITS), axis=1)


def full_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, digest, elements, bits) of every row."""

    def run(batches):
        for batch in batches:
            for part, h, o in shingle_sets(batch, "text", words):
                bits = parity(h, np.repeat(np.arange(part.num_rows), np.diff(o)), part.num_rows)
                elements = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests(h, o), pa.binary()), elements, pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "digest", "elements", "bits"])

    return identified(docs, doc_id, text).mapInArrow(run, f"id {id_type(docs, doc_id)}, digest binary, elements array<long>, bits binary")


def _may_link(num: int, den: int):
    """Size and position filter on a pair of list entries (n, pos) and (n2, pos2)."""
    need = F.expr(f"((n + n2) * {num} + {num + den - 1}) div {num + den}")
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return (F.least("n", "n2") * den >= F.greatest("n", "n2") * num) & (rest >= need)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(left, "a").join(right, "b").where(shared * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def block_pairs(num: int, den: int):
    """A function for mapInArrow over ``in_blocks`` of open lists: pairs of different components that may link."""

    def run(batches):
        for table, end in whole_parts(batches, "list"):
            sid, n, pos, component = (table.column(c).to_numpy() for c in ("sid", "n", "pos", "component"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(sid), -1)
            placed, a, b, held = where(table), [], [], 0
            for i, j in pairs_at(end):
                need = -(-(n[i] + n[j]) * num // (num + den))
                ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
                i, j, need = i[ok], j[ok], need[ok]
                ok = across(placed, i, j) & (np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * need)
                if ok.any():
                    a.append(np.minimum(sid[i[ok]], sid[j[ok]]))
                    b.append(np.maximum(sid[i[ok]], sid[j[ok]]))
                    held += len(a[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ASCII capitals are lower-cased; words are runs of characters other than space and tab to
    carriage return. A set has the distinct ``words``-word shingles of a text, or its whole word
    sequence if shorter. Rows link at a Jaccard similarity of num/den or more; component_id is
    the smallest id reachable. Null and empty texts have an empty set and link with nothing.
    Rows with the same id are versions of one document, and no link by themselves. A row with a
    null id links as a copy only: it takes the component of an equal set that has an id, else null.
    Ids are numbers, or binary (digests).
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with Scratch(spark, "jaccard") as scratch:
        rows = scratch.save(sized(docs, doc_id, text, words), "rows")
        classes = scratch.save(rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("s").alias("s")), "classes")
        sizes = {r.n: r["count"] for r in classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}  # LARGEST_LIGHT rows at most
        x = boundary(sizes, num, den)

        # keys that two different sets hold, and the sets that share enough of them with anyone
        shared = postings(docs, text, words, num, den, x).groupBy("key", "light").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("key", "light")
        shared = scratch.save(shared, "shared")
        held = scratch.save(postings(docs, text, words, num, den, x).join(shared, ["key", "light"], "left_semi").distinct(), "held")
        scratch.drop(shared)
        need = F.expr(f"(({den - num} * (({num} * n + {den - 1}) div {den})) div {den}) div 2 + 1")
        enough = held.groupBy("s", "n").agg(F.count_if(~F.col("light")).alias("keys"), F.bool_or("light").alias("light")).where(F.col("light") | (F.col("keys") >= need)).select("s")
        suspects = scratch.save(classes.join(enough, "s", "left_semi").withColumn("sid", F.monotonically_increasing_id()), "suspects")
        # elements of those rows only that may be a suspect's first one
        whole = bitmap.flagged(full_sets(docs, doc_id, text, words), suspects, F.xxhash64("id", "digest"), bitmap.buckets_for(suspects.count()), "wanted").where("wanted")
        whole = whole.groupBy("digest").agg(F.first("elements").alias("elements"), F.first("bits").alias("bits"))
        sets = scratch.save(whole.join(suspects, "digest").select("sid", "n", "elements", "bits"), "sets")

        # inverted lists over the rarest shingles of each suspect
        tokens = sets.where(F.col("n") >= common(x, num, den)).select("sid", "n", F.explode("elements").alias("key"))
        counts = scratch.save(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")  # a table, so that Spark can split a hot key of the join
        tokens = tokens.join(counts, "key")
        by_set = Window.partitionBy("sid")
        placed = tokens.withColumns({"several": F.count("*").over(by_set), "rank": F.row_number().over(by_set.orderBy("df", "key"))}).withColumn("pos", F.col("n") - F.col("several") + F.col("rank") - 1)
        first = placed.where(F.expr(f"pos <= ({den - num} * n) div {den}")).select("key", F.lit(False).alias("light"), "sid", "n", F.col("pos").cast("long"))
        subsets = held.where("light").join(suspects.select("s", "sid"), "s").select("key", "light", "sid", "n", F.lit(0).cast("long").alias("pos"))
        lists = scratch.save(first.unionByName(subsets), "lists")
        scratch.drop(held)

        # each member meets the list's centre
        centre = lists.groupBy("key", "light").agg(F.min(F.struct("pos", "sid", "n")).alias("c"), F.count("*").alias("k")).where("k > 1").select("key", "light", F.col("c.sid").alias("b"), F.col("c.n").alias("n2"), F.col("c.pos").alias("pos2"))
        centre = scratch.save(centre, "centre")
        met = lists.join(centre, ["key", "light"]).where(F.col("sid") != F.col("b")).where(_may_link(num, den))
        met = met.select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct()
        stars = connected_components(verified(met, sets, num, den), scratch)

        # members of different components meet where a list has several
        tagged = lists.join(stars, F.col("sid") == F.col("node"), "left").select(F.xxhash64("key", "light").alias("list"), "sid", "n", "pos", F.coalesce("component", "sid").alias("component"))
        tagged = scratch.save(tagged, "tagged")
        several = tagged.groupBy(F.col("list").alias("k")).agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("k", "held")
        several = scratch.save(several, "several")
        open_lists = tagged.join(several, F.col("list") == F.col("k"), "left_semi").join(sets.select("sid", "bits"), "sid")
        rest = in_blocks(open_lists, "list", "sid", several, BLOCK_ROWS).mapInArrow(block_pairs(num, den), "a long, b long").distinct()
        edges = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(rest, sets, num, den))
        final = connected_components(edges, scratch)

        # the smallest id of each component, and through the digest of every row
        named = classes.join(suspects.select("digest", "sid"), "digest", "left").join(final, F.col("sid") == F.col("node"), "left")
        smallest = scratch.save(named.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "smallest")
        named = named.join(smallest, "component", "left").select("digest", F.coalesce("least", "id").alias("component_id"))
        return scratch.keep(rows.join(named, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")))
