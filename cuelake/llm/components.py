"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cuelake.llm.workdir import Scratch

#: Edges of a table from which on the two sides of a join are written first.
MANY_EDGES = 1_000_000


def _written(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and two sums of hashes, observed as they are written."""
    h, seen = F.xxhash64("u", "v"), Observation()
    table = scratch.save(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")), name)
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Rounds of large-star and small-star (Kiveris et al., 2014): each node links its larger
    neighbours, then its smaller ones, to the smallest node it knows. The edges become stars in
    a logarithmic number of rounds; they are written after each round. Of a large table the
    smallest neighbours are written too, so that Spark can split the edges of a heavy centre over
    tasks when the two meet. A null end drops the edge; repeated edges and loops do no harm; without
    edges the result is empty.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    (now, seen), before = _written(pairs, scratch, "edges"), None
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    many, sides = seen[0] > MANY_EDGES, []

    def met(df: DataFrame) -> DataFrame:
        if many:
            sides.append(scratch.save(df, "side"))
        return sides[-1] if many else df

    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = met(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = met(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = met(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last = seen
        after, seen = _written(small, scratch, "stars")
        scratch.drop(*sides)
        sides.clear()
        if before is not None:
            scratch.drop(before)
        before, now = now, after
        if seen == last:
            scratch.drop(before)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
