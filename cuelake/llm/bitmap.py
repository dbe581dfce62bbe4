"""A bitmap of hashed keys that is broadcast: of bounded size, it loses no member and lets some others pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places to a bucket, and buckets of the largest bitmap: 64 MB.
PLACES, MOST_BUCKETS = 32_768, 16_384


def buckets_for(members: int) -> int:
    """Buckets of 4 KB for eight places a member, within the bound."""
    return min(MOST_BUCKETS, max(64, members * 8 // PLACES))


def flagged(rows: DataFrame, members: DataFrame, key: Column, buckets: int, name: str) -> DataFrame:
    """``rows`` with the column ``name``: whether ``key``, a 64-bit hash of columns that both frames have, may be among ``members``."""
    place = F.pmod(key, F.lit(buckets * PLACES))
    bits = members.select(place.alias("p")).groupBy(F.floor(F.col("p") / PLACES).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("p") % PLACES).alias("_bits"))
    placed = rows.withColumn("_p", place).join(F.broadcast(bits), F.floor(F.col("_p") / PLACES) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_p") % PLACES / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.withColumn(name, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0, F.lit(False))).drop("_p", "_bucket", "_bits")
