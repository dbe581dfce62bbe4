"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Walsh-Hadamard transform; the hash of a
rotated vector is its largest coordinate with its sign. Several of them make a bucket of one
table; the last may be coarse, so that the number of buckets follows that of the vectors. A
vector is stored under its best bucket of each table and also looks into the next best ones
(multiprobe). What goes through the buckets is an id and 256 sign bits, not the vector: those that
meet in a bucket and whose bits differ in no more places than a linked pair's may are candidates.

Each bucket gives a spanning forest of its candidates, and the pairs of the forest are verified by
their cosine in double precision. Where one of them fails, all pairs of that bucket's candidates
are verified. Links so found make components; inside a component all pairs are compared to count
links.

Equal vectors are one class. A crowded bucket or component is split into blocks that are compared
two by two in separate tasks, so none is bounded by one task's memory, and no pair is written.
"""

from __future__ import annotations

import hashlib
import itertools
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.blocks import across, each_part, in_blocks, pairs_at, where, whole_parts
from cuelake.llm.components import connected_components
from cuelake.llm.workdir import Scratch


#: Sign bits that stand for a vector in the buckets.
SKETCH_BITS = 256


def parse(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; null for those that are null, empty, zero or hold null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for ok, i, j in zip(valid, offsets[:-1], offsets[1:], strict=True):
        v = values[i:j]
        out.append(v if ok and j > i and np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int, hashes: int, last: int, probes: int) -> np.ndarray:
    """Bucket numbers of unit vectors of one width: rows x tables x probes, the best first. The last hash has ``last`` values."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    choices = [c for c in itertools.product(range(2), repeat=hashes)]
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        value, loss = np.empty((hashes, 2, n), np.int64), np.zeros((hashes, 2, n))
        for k in range(hashes):
            signs = np.random.default_rng([width, t, k]).choice([-1.0, 1.0], (3, width))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[np.arange(n), best]
            value[k, 0] = best * 2 + (y[np.arange(n), best] < 0)
            size[np.arange(n), best] = -1
            second = size.argmax(axis=1)
            value[k, 1] = second * 2 + (y[np.arange(n), second] < 0)
            loss[k, 1] = top - size[np.arange(n), second]
        value[-1] %= last
        total = np.stack([sum(loss[k, c[k]] for k in range(hashes)) for c in choices], axis=1)
        code = np.stack([sum(value[k, c[k]] * (2 * width) ** k for k in range(hashes)) for c in choices], axis=1)
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, order, axis=1)
    return out


def plan(rows: int, width: int) -> tuple[int, int, int, int]:
    """Tables, hashes, values of the last hash and probes: as many buckets as half the ``rows``, so that few vectors meet by chance, and tables so that recall stays.

    A hash of two vectors at cosine 0.95 agrees in about two cases of three, and probing makes up
    for one hash; the tables bring the misses below a thousandth.
    """
    values, wanted = 2 * max(2, width), max(2.0, rows / 2)
    hashes = max(2, ceil(log(wanted) / log(values) - 1e-9))
    last = min(values, max(2, ceil(wanted / values ** (hashes - 1))))
    met = 0.66 ** (hashes - 2) * (0.66 + 0.34 / last)
    return ceil(log(0.001) / log(1 - met)), hashes, last, 4


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCH_BITS sign bits of rotations other than the tables', packed."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    bits = []
    for k in range(-(-SKETCH_BITS // width)):
        y = padded
        for s in np.random.default_rng([width, 1 << 20, k]).choice([-1.0, 1.0], (3, width)):
            y = hadamard(y * s)
        bits.append(y > 0)
    return np.packbits(np.concatenate(bits, axis=1)[:, :SKETCH_BITS], axis=1)


def most_differences(least_cosine: float) -> int:
    """Sign bits in which a linked pair may differ: the mean and six standard deviations."""
    p = acos(min(1.0, max(-1.0, least_cosine))) / pi
    return int(SKETCH_BITS * p + 6 * sqrt(SKETCH_BITS * p * (1 - p)))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs, by hooking and jumping."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least_cosine: float = 0.95, block_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of the same length link if they are found as candidates and their cosine is
    ``least_cosine`` or more. n_links counts the other rows linked directly, component_id is the
    smallest id reachable, kept tells whether the row has that id. Vectors that are null, zero or
    hold null or non-finite components link with nothing and are their own component. A row with a
    null id has no links, a null component and is not kept; repeated rows link with each other, and
    rows of one id with unlike vectors have the links of their own vector each. An empty table gives an empty result; other columns are ignored.
    """
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        return scratch.keep(_near(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), least_cosine, block_rows, scratch))


def _near(vectors: DataFrame, least_cosine: float, block_rows: int, scratch: Scratch) -> DataFrame:

    def classify(batches):
        for batch in batches:
            keys, units = [], []
            for v in parse(batch.column(1)):
                u = None if v is None else unit(v)
                keys.append(None if u is None else hashlib.md5(u.tobytes() + len(u).to_bytes(8, "little")).digest())
                units.append(None if u is None else u.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["id", "class_key", "unit"])

    rows = scratch.save(vectors.mapInArrow(classify, "id long, class_key binary, unit binary"), "rows")
    usable = rows.where("id is not null and class_key is not null")
    classes = scratch.save(usable.groupBy("class_key").agg(F.min("id").alias("least"), F.count("*").alias("members"), F.min("unit").alias("unit")).withColumn("rep", F.monotonically_increasing_id()), "classes")  # known by a number: ids may repeat with unlike vectors
    figures = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("width")).first()
    tables, hashes, last, probes = plan(figures.n, (figures.width or 8) // 8)

    def spread(batches):
        for batch in batches:
            unit_bytes = batch.column("unit").to_pylist()
            for size in sorted({len(u) for u in unit_bytes}):
                at = np.array([i for i, u in enumerate(unit_bytes) if len(u) == size])
                x = np.frombuffer(b"".join(unit_bytes[i] for i in at), np.float64).reshape(len(at), -1)
                for i in range(0, len(at), 2048):
                    rows_at = at[i : i + 2048]
                    b = buckets(x[i : i + 2048], tables, hashes, last, probes)
                    # the table and the vector's length are part of a bucket's number
                    code = (b * tables + np.arange(tables)[None, :, None]) * 4099 + size // 8 % 4099
                    bits = [s.tobytes() for s in sketch(x[i : i + 2048])]
                    each = tables * probes
                    yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(np.repeat(rows_at, each))), pa.array(code.reshape(-1)), pa.array(np.tile(np.arange(probes) == 0, len(rows_at) * tables)), pa.array(bits, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows_at)), each)))], ["rep", "bucket", "own", "bits"])

    def meet(batches):
        most = most_differences(least_cosine)
        for table, end in whole_parts(batches, "bucket"):
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            rep, own, placed = table.column("rep").to_numpy(), table.column("own").to_numpy(), where(table)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in pairs_at(end):
                ok = (own[i] | own[j]) & (rep[i] != rep[j]) & across(placed, i, j)
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most
                a.append(i[ok])
                b.append(j[ok])
            label = forest(np.concatenate(a), np.concatenate(b), table.num_rows)
            hit = np.flatnonzero(rep[label] != rep)
            if len(hit):
                place = table.column("bucket").to_numpy()[hit] * 1_000_003 + placed[0][hit]
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(rep[hit]), pa.array(rep[label[hit]])], ["place", "a", "b"])

    entries = classes.select("rep", "unit").mapInArrow(spread, "rep long, bucket long, own boolean, bits binary")
    sizes = entries.groupBy(F.col("bucket").alias("k")).agg(F.count("*").alias("held"), F.count_if("own").alias("owners")).where("held > 1 and owners > 0")
    near = scratch.save(in_blocks(entries, "bucket", "rep", scratch.save(sizes, "sizes"), block_rows).mapInArrow(meet, "place long, a long, b long"), "near")

    def compare(batches):
        for batch in batches:
            ua, ub = batch.column("ua").to_pylist(), batch.column("ub").to_pylist()
            ok = [len(x) == len(y) and bool(np.frombuffer(x) @ np.frombuffer(y) >= least_cosine) for x, y in zip(ua, ub, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    def linked_pairs(table: pa.Table):
        """Places of the linked pairs of a part of vectors, each pair of blocks once."""
        units = table.column("unit").to_pylist()
        length = np.array([len(u) for u in units])
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            x = np.frombuffer(b"".join(units[k] for k in at), np.float64).reshape(len(at), -1)
            i, j = np.nonzero(np.triu(x @ x.T >= least_cosine, 1))
            ok = across(where(table), at[i], at[j])
            yield at[i[ok]], at[j[ok]]

    def again(batches):
        for table in each_part(batches, "cluster"):
            rep = table.column("rep").to_numpy()
            for i, j in linked_pairs(table):
                label = forest(i, j, len(rep))
                hit = np.flatnonzero(rep[label] != rep)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(rep[label[hit]])], ["a", "b"])

    def count(batches):
        for table in each_part(batches, "component"):
            n, rep, members = table.num_rows, table.column("rep").to_numpy(), table.column("members").to_numpy()
            for i, j in linked_pairs(table):
                links = np.bincount(i, members[j], n) + np.bincount(j, members[i], n)
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64))], ["rep", "links"])

    units = classes.select("rep", "unit")
    pairs = near.select("a", "b").distinct().join(units.select(F.col("rep").alias("a"), F.col("unit").alias("ua")), "a").join(units.select(F.col("rep").alias("b"), F.col("unit").alias("ub")), "b")
    pairs = scratch.save(pairs.select("a", "b", "ua", "ub").mapInArrow(compare, "a long, b long, linked boolean"), "pairs")
    # candidates of one bucket whose forest has a pair that fails: all their pairs are compared
    cluster = F.xxhash64("place", "b").alias("cluster")
    open_ = near.join(pairs.where("not linked"), ["a", "b"], "left_semi").select(cluster).distinct()
    whole = near.select(cluster, "a", "b").join(open_, "cluster", "left_semi").select("cluster", F.explode(F.array("a", "b")).alias("rep")).distinct()
    whole = scratch.save(whole, "open")
    sizes = scratch.save(whole.groupBy(F.col("cluster").alias("k")).agg(F.count("*").alias("held")), "clusters")
    more = in_blocks(whole.join(units, "rep"), "cluster", "rep", sizes, block_rows).mapInArrow(again, "a long, b long")
    parts = scratch.save(connected_components(pairs.where("linked").select("a", "b").unionByName(more), scratch), "components")
    held = scratch.save(parts.groupBy(F.col("component").alias("k")).agg(F.count("*").alias("held")), "held")
    joined = classes.select("rep", "members", "unit").join(parts, F.col("rep") == F.col("node")).drop("node")
    counts = in_blocks(joined, "component", "rep", held, block_rows).mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.drop("unit").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = scratch.save(classes.where("component is not null").groupBy("component").agg(F.min("least").alias("named")), "named")
    classes = classes.join(named, "component", "left").select("class_key", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), F.coalesce("named", "least").alias("component"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("class_key")).alias("class_key")).join(classes, "class_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
