"""Connected components of an edge table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import bitmap, has_bit, release, stored

MOST_ROUNDS = 60
#: A key of more rows than this is dealt to ``SALTS`` parts, each with a copy of what the key looks up.
CROWD, SALTS = 10_000, 256
#: Longs of the bitmap of such keys: 32 KB.
CELLS = 1 << 12


def crowded(rows: DataFrame, key: str) -> Column | None:
    """Whether a key is one of those with more than ``CROWD`` rows, or seems to be; None if there is none."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(F.xxhash64(key).alias("h"))
    return has_bit(F.xxhash64(key), bitmap(many, CELLS), CELLS) if many.limit(1).count() else None


def look_up(rows: DataFrame, found: DataFrame, key: str, by: str, many: Column | None) -> DataFrame:
    """The rows with what ``found`` has for their key; rows of a crowded key are dealt by a hash of ``by``."""
    if many is None:
        return rows.join(found.hint("merge"), key, "left")
    dealt = rows.withColumn("part", F.when(many, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    each = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(many, SALTS - 1).otherwise(0))))
    return dealt.join(each.hint("merge"), [key, "part"], "left").drop("part")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``(a, b)``; the label is the least node reachable.

    Nothing but counts and a small bitmap of crowded keys reaches the driver.
    Each round is written to the shared folder and the one before deleted; a
    round takes the least label of all neighbours, then the label of that label,
    so the rounds grow with the logarithm of the diameter. The many edges of a
    hub and the many nodes of one label are dealt to parts. No edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    hubs = crowded(both, "b")
    kept = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        labels = kept.select("node", "label")
        near = look_up(both, labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b", "a", hubs).groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = stored(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "lower")
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = look_up(lower, hop, "label", "node", crowded(lower, "label")).select("node", "old", F.least("label", "far").alias("label"))
        before, kept = kept, stored(jumped, "labels")
        release(before, lower)
        if not kept.where("label < old").limit(1).count():
            release(both)
            return kept.select("node", "label")
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
