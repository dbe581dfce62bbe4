"""Exact top-k by inner product: a Voronoi kNN join.

Data and queries are grouped by their nearest pivot. With a pivot p, a member x at distance d, and
a query q at distance at most r from the pivot c of its group, Cauchy and Schwarz give

    |q.x - c.p| <= |c| d + r |p| + r d,

and the triangle inequality, as 2 q.x = |q|^2 + |x|^2 - |q - x|^2, bounds the product through

    |c - p| - r - d <= |q - x| <= |c - p| + r + d.

From the nearest distances of each data group follows a score that k data vectors reach for every
query of a group; a vector whose upper bound is less is not sent there. What is sent is cut into
blocks, so that each pair of a query block and a data block is solved by itself, and the block
results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.workdir import Scratch

#: Most pivots of data (else the root of their number) and of queries (else one to 512, but 7): a sample, for each length of vectors the first in the order of a hash of the id.
PIVOTS, QUERY_PIVOTS, QUERY_BLOCK = 256, 256, 512
FOUND = "query_id long, query_key long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>): components floor(scale * x) in double precision; rows that are null anywhere or hold non-finite components are left out."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, width, pivot, dist, norm): the nearest pivot of the row's length, the first of equally near ones, and the row's own length."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")], np.int64)
            for width in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                x = matrix(part.column("v")).astype(np.float64)
                p = pivots.get(int(width), np.zeros((1, width)))
                square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None]
                at = square.argmin(axis=1)
                dist = np.sqrt(((x - p[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(np.full(len(x), width)), pa.array(at.astype(np.int64)), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))], ["id", "v", "width", "pivot", "dist", "norm"])

    return rows.mapInArrow(run, "id long, v array<long>, width long, pivot long, dist double, norm double")


def sample_pivots(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """At most ``count`` distinct vectors of each length."""
    first = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id")
    picked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count).select("id", "v").collect()
    out: dict[int, dict] = {}
    for r in sorted(picked, key=lambda r: r.id):
        out.setdefault(len(r.v), {})[tuple(r.v)] = None
    return {w: np.array(list(v), np.float64).reshape(len(v), w) for w, v in out.items()}


def bounds(q, g, c: np.ndarray, p: np.ndarray, floor: float) -> float:
    """The least distance from its pivot at which a member of data group ``g`` can reach ``floor`` for a query of group ``q``; infinite if none can."""
    apart, norm_c, norm_p = float(np.linalg.norm(c - p)), float(np.linalg.norm(c)), float(np.linalg.norm(p))
    most = q.longest**2 + g.longest**2 - 2 * floor
    if floor > q.longest * g.longest or most < 0:
        return math.inf
    slope, rest = norm_c + q.radius, floor - float(c @ p) - q.radius * norm_p
    by_product = rest / slope if slope > 0 else (0.0 if rest <= 0 else math.inf)
    return max(0.0, by_product, apart - q.radius - math.sqrt(most))


def reached(q, g, c: np.ndarray, p: np.ndarray, dist: float) -> float:
    """A score that a member at this distance from its pivot has at least, for every query of group ``q``."""
    apart, norm_c, norm_p = float(np.linalg.norm(c - p)), float(np.linalg.norm(c)), float(np.linalg.norm(p))
    by_product = float(c @ p) - q.radius * norm_p - (norm_c + q.radius) * dist
    return max(by_product, (q.shortest**2 + g.shortest**2 - (apart + q.radius + dist) ** 2) / 2)


def routes(data: list, near: list, queries: list, pivots: dict[int, np.ndarray], query_pivots: dict[int, np.ndarray], k: int, block: int) -> list[tuple]:
    """(width, pivot, query group, least distance, data blocks, query blocks) of each data group that a query group needs.

    ``data`` and ``queries`` are rows (width, pivot, members, radius, shortest, longest), ``near``
    rows (width, pivot, dist) of the k + 1 nearest members of each data group, no id twice: one more
    than k, as a query's id may be one.
    """
    out = []
    for q in queries:
        c, groups = query_pivots[q.width][q.pivot], {g.pivot: g for g in data if g.width == q.width}
        lows = sorted((reached(q, groups[n.pivot], c, pivots[q.width][n.pivot], n.dist) for n in near if n.width == q.width), reverse=True)
        floor = lows[k] - 1e-6 * (1 + abs(lows[k])) if len(lows) > k else -math.inf
        need = {}
        for pivot, g in groups.items():
            least = bounds(q, g, c, pivots[q.width][pivot], floor) if floor > -math.inf else 0.0
            if g.radius >= least:
                need[pivot] = (least, g.members)
        blocks = max(1, math.ceil(sum(m for _, m in need.values()) / block))
        out += [(q.width, pivot, q.pivot, least, blocks, max(1, math.ceil(q.members / QUERY_BLOCK))) for pivot, (least, _) in need.items()]
    return out


def best(query: pa.Table, data: pa.Table, k: int) -> pa.RecordBatch:
    """The k best of a data block for each query of a block; ties to smaller ids."""
    ids, q, x = data.column("id").to_numpy(), matrix(query.column("v")), matrix(data.column("v"))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    scores = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.T.astype(np.int64)
    rows = []
    for i, own in enumerate(query.column("id").to_numpy()):
        other = np.flatnonzero(ids != own)
        s = scores[i, other]
        if len(s) > k:
            high = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            other, s = other[high], s[high]
        order = np.lexsort((ids[other], -s))[:k]
        rows.append((np.full(len(order), i), ids[other[order]], s[order]))
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([query.column("id").combine_chunks().take(pa.array(at)), query.column("key").combine_chunks().take(pa.array(at)), pa.array(np.concatenate([r[1] for r in rows]) if rows else at), pa.array(np.concatenate([r[2] for r in rows]) if rows else at)], ["query_id", "query_key", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to smaller ids.

    ``is_query`` is a condition on ``id``. Components become floor(scale * x). Candidates are all
    rows with another id than the query's and as many components. Vectors that are null, or hold
    null or non-finite components, and rows with a null id take no part. Repeated rows are
    candidates each; equal queries are answered once. With fewer than k candidates all are
    returned; an empty table gives an empty result. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "topk") as scratch:
        rows = whole_vectors(vectors, vec_id, vector, scale)
        return scratch.keep(_joined(rows, rows.where(is_query).distinct(), scratch, k, block))


def _joined(rows: DataFrame, asked: DataFrame, scratch: Scratch, k: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    pivots, query_pivots = sample_pivots(rows, min(PIVOTS, max(1, math.isqrt(rows.count())))), sample_pivots(asked, min(QUERY_PIVOTS, max(7, asked.count() // QUERY_BLOCK)))
    data = scratch.save(nearest(rows, pivots), "data")
    queries = scratch.save(nearest(asked, query_pivots).withColumn("key", F.xxhash64("v")), "queries")
    # summaries: a row a group, k + 1 distances a data group
    groups = lambda df: df.groupBy("width", "pivot").agg(F.count("*").alias("members"), F.max("dist").alias("radius"), F.min("norm").alias("shortest"), F.max("norm").alias("longest")).collect()
    once = data.groupBy("width", "id").agg(F.min(F.struct("dist", "pivot")).alias("m")).select("width", "m.pivot", "m.dist")  # a bound an id: of the k + 1 the query's own rows hold one at most
    near = once.select("width", "pivot", "dist", F.row_number().over(Window.partitionBy("width", "pivot").orderBy("dist")).alias("rank")).where(F.col("rank") <= k + 1).collect()
    table = routes(groups(data), near, groups(queries), pivots, query_pivots, k, block)
    plan = spark.createDataFrame(table, "w long, p long, target long, least double, blocks long, query_blocks long")
    spread = lambda column, n: F.pmod(F.xxhash64(column), n)
    sent = data.join(F.broadcast(plan), (F.col("width") == F.col("w")) & (F.col("pivot") == F.col("p"))).where("dist >= least - 1e-9 * (1 + least)")  # at most PIVOTS x QUERY_PIVOTS short rows a width
    sent = sent.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1))).select("width", F.col("target").alias("group"), "query_block", spread("id", F.col("blocks")).alias("block"), "id", "v")
    shapes = plan.select(F.col("w"), F.col("target"), "blocks", "query_blocks").distinct()
    put = queries.join(F.broadcast(shapes), (F.col("width") == F.col("w")) & (F.col("pivot") == F.col("target"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    put = put.select("width", F.col("pivot").alias("group"), spread("id", F.col("query_blocks")).alias("query_block"), "block", "id", "key", "v")
    keys = ["width", "group", "query_block", "block"]

    def solve(query: pa.Table, part: pa.Table) -> pa.Table:
        if not query.num_rows or not part.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "query_key", "vec_id", "score")})
        return pa.Table.from_batches([best(query, part, k)])

    found = put.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, FOUND)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
