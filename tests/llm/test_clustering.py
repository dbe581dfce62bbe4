import hashlib
import math

import numpy as np
import pytest

from cuelake.llm import clustering

SHAPE = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, seed=3, scale=1024):
    """Each kept row's (vec_id, cluster, distance, cluster_inertia, inertia, sha256), with whole distances in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), clustering.coefficients(np.array([r[1]])).tolist()))
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, sum(x for x, y in at if y == c), sum(x for x, _ in at), said[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-5000, 5000, (40, 64)), rng.integers(-5000, 5000, (9, 64))
    assert (((clustering.coefficients(v)[:, None] - clustering.coefficients(c)[None]) ** 2).sum(2) == 64 * ((v[:, None] - c[None]) ** 2).sum(2)).all()
    assert (clustering.components(clustering.coefficients(v)) == v).all()
    rows = clustering.coefficients(np.eye(64, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(64))  # coarse to fine


def test_progressive_search_finds_the_first_nearest():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 400):
        c = rng.integers(-spread, spread + 1, (8, 64))
        c[5] = c[2]
        v = np.concatenate([rng.integers(-spread, spread + 1, (300, 64)), c])
        at, square, compared = clustering.nearest(clustering.coefficients(v), clustering.coefficients(c))
        whole = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (at == whole.argmin(1)).all() and (square == 64 * whole.min(1)).all()
    near = c[rng.integers(0, 8, 500)] + rng.integers(-2, 3, (500, 64))
    assert clustering.nearest(clustering.coefficients(near), clustering.coefficients(c))[2] < 0.5 * 500 * 8 * 64  # most centroids go early


def test_against_whole_distances(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(120, 64)) * rng.choice([0.1, 1, 7], (120, 1))).tolist())]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (500, None), (501, []), (502, [0.5] * 63), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (505, [None] + [0.0] * 63), (506, [0.0] * 65)]
    rows += [(600 + i, [1.0] * 64) for i in range(40)]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert found(clustering.cluster_vectors(df)) == brute(rows)
    assert found(clustering.cluster_vectors(df, k=3, rounds=2, seed=9, scale=10)) == brute(rows, 3, 2, 9, 10)


def test_few_equal_large_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)] + [(9, [2.0] * 64)] * 2
    assert found(clustering.cluster_vectors(spark.createDataFrame(few, SHAPE))) == brute(few)
    large = [(i, [2e3 * ((i * 37 + j * 11) % 23 - 11) for j in range(64)]) for i in range(30)]
    assert found(clustering.cluster_vectors(spark.createDataFrame(large, SHAPE))) == brute(large)
    clash = spark.createDataFrame(few, SHAPE).selectExpr("*", "1 as c", "2 as cluster", "3 as h")
    assert found(clustering.cluster_vectors(clash)) == brute(few)
    assert clustering.cluster_vectors(spark.createDataFrame([], SHAPE)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], SHAPE)).count()
