"""Universes of bit strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit.functions import bits as B


def universe_full(spark: SparkSession, bits: int) -> DataFrame:
    """All strings of ``bits`` bits; more than 32 count as 32, 0 gives the one empty string, 0."""
    if bits < 0:
        raise ValueError("bits must be 0 or more")
    return spark.range(1 << min(bits, B.WORD)).select(F.col("id").alias("v"))


def universe_sample(spark: SparkSession, bits: int, share: int, seed: int = 42) -> DataFrame:
    """``floor(2^bits / share)`` distinct strings without order among them, the same for the same seed.

    A seeded permutation scatters the universe; what it makes of the first ids
    is the draw, without a retry loop or a sort.
    """
    if share < 1 or bits < 0:
        raise ValueError("share must be 1 or more, bits 0 or more")
    bits = min(bits, B.WORD)
    return spark.range((1 << bits) // share).select(B.scatter(F.col("id"), bits, seed).alias("v"))
