"""Which strategy for which strings.

``measure`` looks at the strings: how many, how often each bit is set, and how
large the buckets of two chunk layouts are. Runs of bits are one layout; the
other deals the bits to the chunks by what they tell, so that bits that hardly
vary don't make a chunk of their own. ``estimate`` adds rows shipped through the
exchange and candidate pairs that the residual predicate has to look at, and
``choose`` takes the cheapest. Without a measure values count as spread evenly.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.functions import bits as B
from nearbit.operators.anchors import sizing

log = logging.getLogger("nearbit")

#: Below this many strings a nested loop over one broadcast side is cheapest.
SMALL = 5_000
#: A shipped row costs about this many candidate comparisons.
SHIP_COST = 8.0
#: Largest ball that the choice considers.
MASKS = 2_000
#: Candidates beyond which a warning says that no strategy is cheap.
MANY = 1e12
#: Rows of a band of the grid that is chosen for many strings.
BAND = 20_000


@dataclass(frozen=True)
class Layout:
    """Chunk masks, the sum of their buckets' squared sizes, and the largest bucket."""

    masks: tuple[int, ...]
    squares: float
    largest: int


@dataclass(frozen=True)
class Stats:
    """``shares``: of the strings that have each bit set. ``layouts``: by name."""

    n: int
    shares: tuple[float, ...]
    layouts: dict[str, Layout] = field(default_factory=dict)

    @classmethod
    def even(cls, n: int, d: int, bits: int) -> Stats:
        """As if values were spread evenly."""
        masks = tuple(B.chunk_masks(bits, d + 1))
        sizes = [n / 2 ** m.bit_count() for m in masks]
        return cls(n, (0.5,) * bits, {"runs": Layout(masks, sum(n * s for s in sizes), ceil(max(sizes)))})

    def apart(self) -> list[float]:
        """The shares of pairs at distance 0, 1, 2, ..., if bits were independent."""
        out = [1.0]
        for p in self.shares:
            other = 2 * p * (1 - p)
            out = [a * (1 - other) + b * other for a, b in zip([*out, 0.0], [0.0, *out], strict=True)]
        return out


def bit_counts(points: DataFrame, bits: int) -> DataFrame:
    """``(n, b0, b1, ...)``: strings, and those that have each bit set."""
    return points.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.getbit("v", F.lit(i)).cast("bigint")), F.lit(0)).alias(f"b{i}") for i in range(bits)])


def bucket_statistics(points: DataFrame, layouts: dict[str, list[int]]) -> DataFrame:
    """``(layout, j, buckets, largest, squares)`` of every chunk; one aggregate over all layouts."""
    parts = [F.struct(F.lit(name).alias("layout"), F.lit(j).alias("j"), F.col("v").bitwiseAND(F.lit(m)).alias("k")) for name, masks in layouts.items() for j, m in enumerate(masks)]
    sizes = points.select(F.inline(F.array(*parts))).groupBy("layout", "j", "k").agg(F.count("*").alias("n"))
    return sizes.groupBy("layout", "j").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))


def measure(points: DataFrame, d: int, bits: int) -> Stats:
    """Two aggregates over the strings."""
    counts = bit_counts(points, bits).first()
    n, d = counts["n"], min(d, bits)
    shares = tuple(counts[f"b{i}"] / n if n else 0.0 for i in range(bits))
    layouts = {"runs": B.chunk_masks(bits, d + 1), "dealt": B.dealt_chunks(list(shares), d + 1)}
    found: dict[str, list] = {name: [] for name in layouts}
    if n > SMALL:
        for r in bucket_statistics(points, layouts).collect():  # a row for each chunk
            found[r["layout"]].append((r["squares"], r["largest"]))
    return Stats(n, shares, {name: Layout(tuple(layouts[name]), sum(s for s, _ in rows), max(m for _, m in rows)) for name, rows in found.items() if rows})


def shipped_rows(strategy: str, n: int, d: int, bits: int, grid: int = 8) -> float:
    """Rows through the exchange; the anchor figure is an expectation."""
    d = min(d, bits)
    if strategy == "nested_loop":
        return n
    if strategy == "grid":
        return n * grid
    if strategy == "ball_half":
        return n * (1 + B.ball_size(bits, ceil(d / 2)))
    if strategy == "ball_full":
        return n * (1 + B.ball_size(bits, d) / 2)
    if strategy == "split":
        return n * min(d + 1, bits)
    if strategy == "anchor":
        anchors = min(sizing(bits, d)["anchors"], n)  # only homes have members, a value has one home
        return n * max(1.0, anchors * (1 + B.ball_size(bits, 2 * d)) / 2**bits)
    raise KeyError(strategy)


def common_centres(bits: int, apart: int, radius: int) -> int:
    """Strings within ``radius`` of both of two strings that are ``apart``: flip some of the bits in which they differ, and some others."""
    return sum(comb(apart, i) * comb(bits - apart, k) for i in range(apart + 1) for k in range(bits - apart + 1) if max(i, apart - i) + k <= radius)


def candidate_pairs(strategy: str, stats: Stats, d: int, bits: int, layout: str = "runs") -> float:
    """Pairs looked at after the exchange."""
    d, n = min(d, bits), stats.n
    if strategy in ("nested_loop", "grid"):
        return n * n / 2
    if strategy == "split":
        return stats.layouts[layout].squares / 2
    apart = stats.apart()
    if strategy == "ball_half":
        half = ceil(d / 2)
        return n * n / 2 * sum(apart[t] * common_centres(bits, t, half) for t in range(min(2 * half, bits) + 1))
    if strategy == "ball_full":
        return n * n / 2 * sum(apart[: d + 1])
    if strategy == "anchor":
        return shipped_rows("anchor", n, d, bits) ** 2 / max(1, n)
    raise KeyError(strategy)


def estimate(strategy: str, stats: Stats, d: int, bits: int, grid: int = 8, layout: str = "runs", bucket: int = 4_000) -> dict[str, float]:
    ship, cand = shipped_rows(strategy, stats.n, d, bits, grid), candidate_pairs(strategy, stats, d, bits, layout)
    if strategy == "split" and stats.layouts[layout].largest > bucket:
        ship += stats.layouts[layout].squares / bucket  # a row of a bucket that is cut goes to each of its bands
    return {"shipped": ship, "candidates": cand, "cost": SHIP_COST * ship + cand}


def choose(stats: Stats, d: int, bits: int) -> tuple[str, dict[str, object]]:
    """Cheapest strategy by estimate, and the options that go with it. The anchor strategy is chosen only by name: it ships the most."""
    n, grid = stats.n, max(8, ceil(stats.n / BAND))
    if n <= SMALL:
        return "nested_loop", {}
    if d >= bits:
        return "grid", {"grid": grid}
    ways = {("grid", ""): estimate("grid", stats, d, bits, grid)}
    ways |= {("split", name): estimate("split", stats, d, bits, layout=name) for name in stats.layouts}
    ways |= {("ball_half", ""): estimate("ball_half", stats, d, bits)} if B.ball_size(bits, ceil(d / 2)) <= MASKS else {}
    ways |= {("ball_full", ""): estimate("ball_full", stats, d, bits)} if B.ball_size(bits, d) <= MASKS else {}
    (best, layout), cost = min(ways.items(), key=lambda w: w[1]["cost"])
    log.log(logging.WARNING if cost["candidates"] > MANY else logging.INFO, "%s %s for %s strings of %s bits, distance %s: %.3g rows shipped, %.3g candidates", best, layout, n, bits, d, cost["shipped"], cost["candidates"])
    return best, {"grid": {"grid": grid}, "split": {"chunks": stats.layouts[layout].masks} if layout else {}}.get(best, {})
