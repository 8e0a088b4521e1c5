"""Bit strings as ``BIGINT`` in ``[0, 2^32)``.

Carrying an unsigned 32-bit value in a signed 64-bit column makes ``<`` the
unsigned order and keeps every bit operation inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
TOP = 1 << WORD


def from_int32(col: Column) -> Column:
    """Signed 32-bit int to engine value."""
    return col.cast("bigint").bitwiseAND(F.lit(TOP - 1))


def to_int32(col: Column) -> Column:
    """Engine value to the signed 32-bit int with the same bits."""
    return F.when(col >= TOP // 2, col - TOP).otherwise(col).cast("int")


def render(col: Column, width: int = WORD) -> Column:
    """Zero-padded binary text."""
    return F.lpad(F.bin(col), width, "0")


def parse(col: Column) -> Column:
    """Binary text to engine value."""
    return F.conv(col, 2, 10).cast("bigint")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance (INT)."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


#: Odd multipliers below 2^30, so that a product with a 32-bit value fits a signed 64-bit one.
SCATTER = (747_796_405, 277_803_737, 668_265_263)


def scatter(x: Column, bits: int, seed: int = 0) -> Column:
    """A seeded permutation of the universe: adding, multiplying by odd numbers and folding the upper half onto the lower are all reversible."""
    whole, half = F.lit(1 << bits), (bits + 1) // 2
    for k, m in enumerate(SCATTER):
        x = F.pmod((x + F.lit((seed * (2 * k + 1) + k) % (1 << bits))) * F.lit(m), whole)
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x


def runs(mask: int) -> list[tuple[int, int]]:
    """``(start, width)`` of the runs of set bits of a mask, from the lowest."""
    out, i = [], 0
    while mask >> i:
        if mask >> i & 1:
            width = ((mask >> i) ^ ((mask >> i) + 1)).bit_length() - 1
            out.append((i, width))
            i += width
        i += 1
    return out


def gathered(x: Column, mask: int) -> Column:
    """The bits of ``x`` under the mask, side by side; order and distances stay if no other bits differ."""
    out, at = F.lit(0).cast("bigint"), 0
    for start, width in runs(mask):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, start).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def spread(x: Column, mask: int, rest: int) -> Column:
    """The reverse of :func:`gathered`; ``rest`` has the other bits."""
    out, at = F.lit(rest).cast("bigint"), 0
    for start, width in runs(mask):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, at).bitwiseAND(F.lit((1 << width) - 1)), start))
        at += width
    return out


def ball_size(bits: int, radius: int) -> int:
    """Number of strings at distance 1..radius of a centre."""
    return sum(comb(bits, i) for i in range(1, min(radius, bits) + 1))


def masks(bits: int, radius: int, lowest: int = 1) -> list[int]:
    """XOR masks of weight lowest..radius, by weight, then by value."""
    out: list[int] = []
    for weight in range(lowest, min(radius, bits) + 1):
        out += sorted(sum(1 << p for p in where) for where in combinations(range(bits), weight))
    return out


def unranked(rank: Column, weight: Column, bits: int) -> Column:
    """The mask of that weight with that many smaller ones (combinatorial number system): from the top, bit c is set if C(c, weight left) masks fit below."""
    below = F.array(*[F.lit(comb(c, k)).cast("bigint") for c in range(bits) for k in range(bits + 1)])

    def step(acc: Column, c: Column) -> Column:
        fit = F.get(below, c * (bits + 1) + acc["left"])
        taken = (acc["left"] > 0) & (acc["rank"] >= fit)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), c)
        return F.struct(
            F.when(taken, acc["rank"] - fit).otherwise(acc["rank"]).alias("rank"),
            F.when(taken, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
            F.when(taken, acc["mask"].bitwiseOR(bit)).otherwise(acc["mask"]).alias("mask"),
        )

    start = F.struct(rank.cast("bigint").alias("rank"), weight.cast("int").alias("left"), F.lit(0).cast("bigint").alias("mask"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["mask"]


def chunk_masks(bits: int, parts: int) -> list[int]:
    """Masks of ``parts`` contiguous chunks from the top; widths differ by one at most."""
    parts = max(1, min(parts, bits))
    base, wider = divmod(bits, parts)
    out, left = [], bits
    for i in range(parts):
        width = base + (i < wider)
        left -= width
        out.append(((1 << width) - 1) << left)
    return out


def entropy(share: float) -> float:
    """Bits that a bit tells which is set in that share of the strings."""
    return -sum(p * log2(p) for p in (share, 1 - share) if p > 0)


def dealt_chunks(shares: list[float], parts: int) -> list[int]:
    """Masks of ``parts`` chunks that tell about equally much: bits by falling entropy, each to the chunk that has least."""
    parts = max(1, min(parts, len(shares)))
    told, out = [0.0] * parts, [0] * parts
    order = sorted(range(len(shares)), key=lambda i: (-entropy(shares[i]), -i))
    for k, i in enumerate(order):
        j = k if k < parts else min(range(parts), key=lambda c: (told[c], c))
        told[j] += entropy(shares[i])
        out[j] |= 1 << i
    return out


def first_equal_chunk(xor: Column, layout: list[int]) -> Column:
    """Index of the first chunk in which two strings agree, from their XOR; null if none."""
    found = None
    for j, m in enumerate(layout):
        test = xor.bitwiseAND(F.lit(m)) == 0
        found = F.when(test, j) if found is None else found.when(test, j)
    return found


def clear_lowest(x: Column, k: Column, most: int) -> Column:
    """``x`` without its ``k`` lowest set bits; ``most`` bounds ``k``."""
    steps = [x]
    for _ in range(most):
        steps.append(steps[-1].bitwiseAND(steps[-1] - 1))
    out = F.when(k == 0, steps[0])
    for i in range(1, most + 1):
        out = out.when(k == i, steps[i])
    return out


# Which of ``n`` reducers a key goes to.


def reducer_of_value(value: str, n: int) -> Column:
    """By the size of the signed 32-bit value."""
    signed = F.when(F.col(value) >= TOP // 2, F.col(value) - TOP).otherwise(F.col(value))
    return F.pmod(F.abs(signed), F.lit(n)).cast("int")


def reducer_of_pair(left: str, right: str, n: int) -> Column:
    """By the sum of what both leave."""
    return F.pmod(F.pmod(F.abs(left), F.lit(n)) + F.pmod(F.abs(right), F.lit(n)), F.lit(n)).cast("int")


def reducer_of_chunk(chunk: Column, number: Column, parts: int, n: int) -> Column:
    """Chunks of one value in a row, the next value behind them."""
    return F.pmod(chunk * parts + number, F.lit(n)).cast("int")
