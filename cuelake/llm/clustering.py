"""Centroid clustering with a progressive search over Walsh-Hadamard coefficients.

The transform of integers is exact, and it keeps distances up to a factor: 64 components give 64
coefficients whose squared differences add up to 64 times the squared distance. Coefficients stand
in order of their number of sign changes, coarse ones first. The search adds up squared
differences range by range; a centroid whose sum so far exceeds the whole distance of another one
is strictly worse and goes, and what is left at the end has been compared on all coefficients.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.workdir import Scratch

WIDTH = 64
#: Ends of the ranges of coefficients that are compared one after the other.
RANGES = (4, 8, 16, 32, 64)
#: Components up to this size give sums below 2^63; larger ones are added up as Python integers.
MOST = 1 << 24


def sign_change_order(width: int = WIDTH) -> np.ndarray:
    """Rows of the natural transform by their number of sign changes: bit-reversed Gray codes."""
    bits = width.bit_length() - 1
    return np.array([int(format(i ^ i >> 1, f"0{bits}b")[::-1], 2) if bits else 0 for i in range(width)])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unscaled transform of each row, by sums and differences; applied twice it multiplies by the width."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, width)


def coefficients(x: np.ndarray) -> np.ndarray:
    return hadamard(x)[:, sign_change_order(x.shape[1])]


def components(c: np.ndarray) -> np.ndarray:
    """The inverse of ``coefficients``."""
    natural = np.empty_like(c)
    natural[:, sign_change_order(c.shape[1])] = c
    return hadamard(natural) // c.shape[1]


def exact(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``x`` as it can be compared with ``others`` without overflow."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in (x, *others) if a.size), default=0)
    return x if most <= MOST * WIDTH else x.astype(object)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance times the width, coefficients compared), all from coefficients.

    Of equally near centroids the first.
    """
    v = exact(vectors, centroids)
    c = centroids.astype(v.dtype)
    n, k = len(v), len(c)
    so_far = np.zeros((n, k), v.dtype)
    alive = np.ones((n, k), bool)
    bound, compared, begin = None, 0, 0
    for end in RANGES:
        i, j = np.nonzero(alive)
        so_far[i, j] += ((v[i, begin:end] - c[j, begin:end]) ** 2).sum(axis=1)
        compared += len(i) * (end - begin)
        if bound is None:  # the whole distance of the one that looks best
            guess = so_far.argmin(axis=1)
            bound = so_far[np.arange(n), guess] + ((v[:, end:] - c[guess][:, end:]) ** 2).sum(axis=1)
            compared += n * (WIDTH - end)
        alive &= so_far <= bound[:, None]
        begin = end
    worst = so_far.max(initial=0) + 1
    whole = np.where(alive, so_far, worst)
    at = whole.argmin(axis=1)
    return at, whole[np.arange(n), at], compared


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, c array<long>): coefficients of the integers floor(scale * x), x in double precision; only vectors of 64 components, none of them null or non-finite."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where((F.size("v") == WIDTH) & good)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
            if x.size and np.abs(x).max() >= 1 << 55:
                raise OverflowError("components are too large for distances of 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(coefficients(x.astype(np.int64)))], ["vec_id", "c"])

    return rows.mapInArrow(transform, "vec_id long, c array<long>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, WIDTH, dtype=np.int32), pa.array(rows.reshape(-1)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows whose ids have the smallest hashes, in order of the hash; rows of one id in order of their coefficients."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    return np.array([r.c for r in hashed.orderBy("h", "c").limit(k).select("c").collect()], np.int64).reshape(-1, WIDTH)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with rows at the floor of their mean, component by component; the others in place.

    Tasks send a row of sums for each centroid. The transform of sums is the sum of transforms.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), WIDTH), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch)
            at, _, _ = nearest(v, centroids)
            for c in np.unique(at):
                sums[c] += exact(v[at == c]).sum(axis=0).astype(object)
            counts += np.bincount(at, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(centroids)), WIDTH)), pa.array(np.tile(np.arange(WIDTH), len(centroids))), pa.array([str(s) for s in sums.reshape(-1)]), pa.array(np.repeat(counts, WIDTH))], ["cluster", "place", "total", "members"])

    added = rows.mapInArrow(add_up, "cluster long, place long, total string, members long")
    total = added.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")).collect()
    sums, counts = np.zeros((len(centroids), WIDTH), object), np.zeros(len(centroids), object)
    for r in total:
        sums[r.cluster, r.place], counts[r.cluster] = int(r.total), r.members
    means = components(sums) // np.maximum(counts, 1)[:, None]
    return np.where((counts > 0)[:, None], coefficients(means), centroids.astype(object)).astype(np.int64)


def cluster_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` rounds.

    Components become floor(scale * x) and stay integers throughout. Centroids start as the k
    vectors of smallest sha256 of ``<seed>:<vec_id>``; each round assigns every vector to the nearest
    centroid (squared distance; ties to the smaller number) and moves a centroid with vectors to the
    floor of their mean. Left out are vectors that are null, have null or non-finite components or
    other than 64 of them. A null id stays and counts as empty text; repeated rows count each; with
    fewer than k vectors there are as many centroids; an empty table gives an empty result.
    Distances and their sums must fit 64 bits, else the job fails.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "clusters") as scratch:
        rows = scratch.save(whole_vectors(vectors, vec_id, vector, scale), "coefficients")
        centroids = first_centroids(rows, k, seed)
        for _ in range(rounds if len(centroids) else 0):
            before, centroids = centroids, moved(rows, centroids)
            if (before == centroids).all():
                break  # every later round would give the same

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, square, _ = nearest(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array([int(s) // WIDTH for s in square], pa.int64())], ["vec_id", "cluster", "distance"])

        found = scratch.save(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
        sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
        said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in components(centroids).tolist()]
        facts = spark.createDataFrame([(c, total, sum(sums.values()), said[c]) for c, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return scratch.keep(found.join(F.broadcast(facts), "cluster")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
