"""Balls: every point with the masks that lead to its neighbours.

Up to ``INLINE_MASKS`` masks are an array literal. More come from a table that
executors make from ranks, so the driver holds a number only: broadcast while it
is small, else cut into blocks that the points meet by an equi-join.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit.functions import bits as B

#: Largest mask list that is inlined as an array literal; longer ones become a table.
INLINE_MASKS = 600
#: Largest mask table that is broadcast: 16 MB of longs.
MASK_LIMIT = 2_000_000
#: Masks of a block of a larger table.
BLOCK = 1 << 16


def mask_count(bits: int, radius: int, lowest: int = 1) -> int:
    return sum(comb(bits, w) for w in range(lowest, min(radius, bits) + 1))


def mask_table(spark: SparkSession, bits: int, radius: int, lowest: int = 1) -> DataFrame:
    """``(id, mask)``: all masks of weight lowest..radius, by weight, then by value."""
    top = min(radius, bits)
    edges, below = [], 0
    for w in range(lowest, top + 1):
        edges.append((w, below))
        below += comb(bits, w)
    rank, weight, start = F.col("id"), None, None
    for w, first in reversed(edges):
        here = rank >= first
        weight = F.when(here, w) if weight is None else weight.when(here, w)
        start = F.when(here, F.lit(first)) if start is None else start.when(here, F.lit(first))
    rows = spark.range(below)
    if not edges:
        return rows.select("id", F.col("id").alias("mask"))
    return rows.select("id", B.unranked(rank - start.cast("bigint"), weight, bits).alias("mask"))


def with_masks(points: DataFrame, bits: int, radius: int, lowest: int = 1) -> DataFrame:
    """One row per point and mask of weight lowest..radius, in a column ``mask``."""
    many, spark = mask_count(bits, radius, lowest), points.sparkSession
    if many <= INLINE_MASKS:
        return points.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in B.masks(bits, radius, lowest)]).cast("array<bigint>")))
    table = mask_table(spark, bits, radius, lowest)
    if many <= MASK_LIMIT:
        return points.crossJoin(F.broadcast(table.select("mask")))  # MASK_LIMIT bounds the table
    blocks = table.select("mask", F.expr(f"id div {BLOCK}").alias("block"))
    every = points.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ceil(many / BLOCK) - 1).cast("bigint"))))
    return every.join(blocks.hint("merge"), "block").drop("block")


def neighbours(points: DataFrame, bits: int, radius: int, lowest: int = 1, *, value: str = "v", name: str = "c") -> DataFrame:
    """One row per point and string at distance lowest..radius, in a column ``name``."""
    return with_masks(points, bits, radius, lowest).withColumn(name, F.col(value).bitwiseXOR(F.col("mask"))).drop("mask")


def in_halves(points: DataFrame, bits: int, radius: int, *, value: str = "v", name: str = "c") -> DataFrame:
    """One row per point and string at distance 1..radius that differs in the lower ``bits // 2`` bits only, or in the others only."""
    low, found = bits // 2, []
    for width, at in ((low, 0), (bits - low, low)):
        some = with_masks(points, width, radius)
        found.append(some.withColumn(name, F.col(value).bitwiseXOR(F.shiftleft("mask", at))).drop("mask"))
    return found[0].unionByName(found[1])
