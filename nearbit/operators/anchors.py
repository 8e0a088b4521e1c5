"""Anchor sets: their size, how they are drawn and held, and what lies near them.

A set is held as its members or, if it fills more than half of the universe, as
what it lacks. There are three ways to find the anchors near a string: scan them
all, meet them in cells, or look up the strings of the ball around it. Scanning
broadcasts the anchors, so it is for sets of a measured size; the others are
equi-joins, whatever the sizes.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from math import ceil, comb, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbit.functions import bits as B
from nearbit.operators.balls import neighbours
from nearbit.operators.cells import FEW, between
from nearbit.sources.scratch import dropped, kept

log_ = logging.getLogger("nearbit")

#: Most anchors that are scanned: 512 KB of longs, broadcast.
SCAN_LIMIT = 1 << 16
#: Bitmaps of 4 KB that are broadcast: 16 MB, 2^27 strings.
BITMAPS = 4_096
#: Of the values that no anchor covers one in so many is drawn in a round; rounds at most; values that are left to be anchors of their own.
COVER_SHARE, COVER_ROUNDS, COVER_BOUND = 8, 12, 1_000
#: A string that is sent costs about as much as this many comparisons.
SHIP_COST = 8
#: Most strings that a draw or its complement holds; beyond, every string is an anchor, which needs no draw.
DRAW_LIMIT = 1 << 20


def target(bits: int, d: int) -> int:
    """Anchors for which about 0.001 strings of the whole universe are expected to be uncovered."""
    whole = 1 << bits
    ball = B.ball_size(bits, d)
    return whole if ball == 0 else min(whole, ceil(log(1000 * whole) * whole / ball))


def mode(size: int, bits: int, d: int) -> str:
    """The cheaper way for a draw of that size: to scan it, or to look up ("expand") the ball of twice the distance."""
    return "scan" if size < B.ball_size(bits, min(2 * d, bits)) and size <= SCAN_LIMIT else "expand"


def way(anchors: AnchorSet, points: DataFrame, bits: int, radius: int) -> str:
    """The cheapest way to find what lies within ``radius``, by counts: to scan few anchors, to look up small balls ("expand"), or to compare in cells."""
    if anchors.complement:
        return "expand"
    ball = SHIP_COST * (1 + B.ball_size(bits, radius))
    size = anchors.table.limit(SCAN_LIMIT + 1).count()
    if size <= SCAN_LIMIT:
        return "scan" if size < ball or points.limit(ball + 1).count() <= ball else "expand"
    return "expand" if points.limit(ball + 1).count() > ball else "cells"


def fills(size: int, bits: int) -> bool:
    """Whether a set takes more than half of the universe, so that it is held as what it lacks."""
    return size > (1 << bits) // 2


def sizing(bits: int, d: int) -> dict[str, object]:
    """What a draw would be: ``anchors``, ``complement`` (held as what it lacks), ``held`` (rows) and ``mode``."""
    whole, wanted = 1 << bits, target(bits, d)
    complement = fills(wanted, bits)
    held = whole - wanted if complement else wanted
    if held > DRAW_LIMIT:
        wanted, complement, held = whole, True, 0
    return {"anchors": wanted, "complement": complement, "held": held, "mode": "expand" if complement else mode(held, bits, d)}


@dataclass(frozen=True)
class AnchorSet:
    """``table``: strings in a column ``c``, which are the anchors or, with ``complement``, all that are none."""

    table: DataFrame
    complement: bool = False

    def keep(self, rows: DataFrame, name: str = "c") -> DataFrame:
        """The rows whose string is an anchor. Sets that fit are held by every task, as strings or as bitmaps, so that the rows stay where they are."""
        held = self.table.select(F.col("c").alias(name)).distinct()
        if held.limit(FEW + 1).count() <= FEW:
            return rows.join(F.broadcast(held), name, "left_anti" if self.complement else "left_semi")
        if (found := bitmaps(held, name)) is None:
            return rows.join(held.hint("merge"), name, "left_anti" if self.complement else "left_semi")
        return in_bitmaps(rows, found, name, self.complement)


def bitmaps(strings: DataFrame, name: str = "c", most: int = BITMAPS) -> DataFrame | None:
    """``(_bucket, _bits)``: a bitmap for each run of 32,768 strings that has one; None if there are more than ``most``."""
    bucket = F.bitmap_bucket_number(name)
    if strings.select(bucket.alias("b")).distinct().limit(most + 1).count() > most:
        return None
    return strings.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("_bits"))


def in_bitmaps(rows: DataFrame, found: DataFrame, name: str = "c", complement: bool = False) -> DataFrame:
    """The rows whose string is in the bitmaps of :func:`bitmaps` (or isn't), which every task holds."""
    at = F.bitmap_bit_position(name)
    digit = F.ascii(F.substring(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), F.when(at.bitwiseAND(F.lit(4)) == 0, 2).otherwise(1), F.lit(1)))
    four = F.when(digit < 58, digit - 48).otherwise(digit - 55)
    has = F.coalesce(F.getbit(four, at.bitwiseAND(F.lit(3)).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(name)).join(F.broadcast(found), "_bucket", "left")
    return marked.where(~has if complement else has).select(*rows.columns)


def covering(values: DataFrame, bits: int, d: int, seed: int, *, share: int = COVER_SHARE, bound: int = COVER_BOUND) -> DataFrame:
    """Anchors drawn from the values themselves, in a column ``c``: every value has one within ``d``.

    A round draws one in ``share`` of the values that none covers yet, and takes
    out what those cover. When no more than ``bound`` values are left, or a round
    covers hardly more than it draws, each value left is an anchor of its own.
    """
    left, found, n = values, [], values.count()
    for k in range(COVER_ROUNDS):
        if n <= bound:
            break
        drawn_now = kept(left.where(F.pmod(F.xxhash64("v", F.lit(seed), F.lit(k)), F.lit(share)) == 0).select(F.col("v").alias("c")))
        size, given = drawn_now.count(), AnchorSet(drawn_now)
        near_them = near(left, given, bits, d, way(given, left, bits, d)).select("v").distinct()
        rest = kept(left.join(near_them.hint("merge"), "v", "left_anti"))
        if left is not values:
            dropped(left)
        found.append(drawn_now)
        left, before, n = rest, n, rest.count()
        log_.info("round %s: %s of %s values drawn as anchors, %s left", k, size, before, n)
        if before - n < 2 * size:  # the values lie too far apart to cover one another
            break
    out = left.select(F.col("v").alias("c"))
    for more in found:
        out = out.unionByName(more)
    return out


def draw(spark: SparkSession, bits: int, count: int, seed: int) -> DataFrame:
    """``count`` distinct strings in a column ``c``, the same for the same seed."""
    return spark.range(count).select(B.scatter(F.col("id"), bits, seed).alias("c"))


def drawn(spark: SparkSession, bits: int, d: int, seed: int) -> AnchorSet:
    size = sizing(bits, d)
    log_.info("%s anchors for %s bits and distance %s, %s rows held, %s", size["anchors"], bits, d, size["held"], size["mode"])
    return AnchorSet(draw(spark, bits, size["held"], seed), size["complement"])


def near(points: DataFrame, anchors: AnchorSet, bits: int, radius: int, how: str) -> DataFrame:
    """``points`` once for each anchor ``c`` within ``radius``, with its distance ``far``."""
    far = B.distance(F.col("v"), F.col("c")).alias("far")
    if how == "scan" and not anchors.complement:
        return points.join(F.broadcast(anchors.table), B.distance(F.col("v"), F.col("c")) <= radius).select(*points.columns, "c", far)
    if anchors.complement:
        return looked_up(points, anchors, bits, radius)
    if how == "cells":
        return between(points, anchors.table.select("c"), B.distance(F.col("v"), F.col("c")) <= radius).select(*points.columns, "c", far)
    around = neighbours(anchors.table.select("c"), bits, radius, 0, value="c", name="v")
    return points.join(around.hint("merge"), "v").select(*points.columns, "c", far)


def looked_up(points: DataFrame, anchors: AnchorSet, bits: int, radius: int) -> DataFrame:
    """The same by the balls around the points; for sets that every task holds, nothing is moved."""
    return anchors.keep(neighbours(points, bits, radius, 0)).select(*points.columns, "c", B.distance(F.col("v"), F.col("c")).alias("far"))


def nearest() -> Column:
    """Of a point's anchors the nearest, of equally near ones the smaller: a struct (far, c), for groups of ``near``'s rows."""
    return F.min(F.struct("far", "c"))


def growing(values: DataFrame, anchors: AnchorSet, bits: int, reach: int) -> DataFrame:
    """``(v, c, far)``: each value's nearest anchor within ``reach``, ties to the smaller.

    Round by round the strings at distance 0, 1, 2, ... of the values that have
    none yet are looked up. When a round would send more strings than there are
    anchors to compare with, the values left meet all anchors in cells, and the
    rounds end. Rounds are written, so that none is computed twice.
    """
    held, left, found = anchors.table.select("c").distinct(), values, []
    size = held.count()
    for far in range(reach + 1):
        if not left.limit(1).count():
            break
        if SHIP_COST * comb(bits, far) > size and not anchors.complement:
            met = between(left, held, B.distance(F.col("v"), F.col("c")) <= reach)
            found.append(met.groupBy("v").agg(F.min(F.struct(B.distance(F.col("v"), F.col("c")).alias("far"), "c")).alias("m")).select("v", "m.c", "m.far"))
            break
        got = kept(anchors.keep(neighbours(left, bits, far, far)).groupBy("v").agg(F.min("c").alias("c")))
        log_.info("distance %s: %s strings a value", far, comb(bits, far))
        found.append(got.withColumn("far", F.lit(far)))
        rest = kept(left.join(got.hint("merge"), "v", "left_anti"))
        if left is not values:
            dropped(left)
        left = rest
    out = found[0] if found else left.select("v", F.lit(None).cast("bigint").alias("c"), F.lit(0).alias("far"))
    for more in found[1:]:
        out = out.unionByName(more)
    return out
