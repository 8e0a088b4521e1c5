from math import comb

import pytest
from pyspark.sql import functions as F

from nearbit.functions import bits as B


@pytest.mark.parametrize("bits", [1, 5, 10, 16])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 20])
def test_masks_are_the_ball(bits, radius):
    found = B.masks(bits, radius)
    assert len(found) == len(set(found)) == B.ball_size(bits, radius) == sum(comb(bits, i) for i in range(1, min(bits, radius) + 1))
    assert all(0 < m < 1 << bits and bin(m).count("1") <= radius for m in found)


@pytest.mark.parametrize("bits", [1, 7, 16, 31, 32])
@pytest.mark.parametrize("parts", [1, 2, 3, 5, 40])
def test_chunks_part_the_string(bits, parts):
    layout = B.chunk_masks(bits, parts)
    widths = [bin(m).count("1") for m in layout]
    assert sum(layout) == (1 << bits) - 1 and sum(widths) == bits
    assert max(widths) - min(widths) <= 1 and sorted(widths, reverse=True) == widths


def test_round_trips(spark):
    values = [0, 1, 2**31 - 1, 2**31, 2**32 - 1]
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in values], "v long").select("v", B.render(v).alias("t"), B.parse(B.render(v)).alias("p"), B.from_int32(B.to_int32(v)).alias("b"), B.to_int32(v).alias("s"))
    for row in df.collect():
        assert row.t == format(row.v, "032b") and row.p == row.v == row.b
        assert row.s == (row.v - 2**32 if row.v >= 2**31 else row.v)


def test_distance_and_lowest_bits(spark):
    df = spark.createDataFrame([(0b1011, 0b0110, k) for k in range(4)], "a long, b long, k int")
    x = F.col("a").bitwiseXOR(F.col("b"))
    got = df.select(B.distance(F.col("a"), F.col("b")), B.clear_lowest(x, F.col("k"), 3)).collect()
    assert [tuple(r) for r in got] == [(3, 0b1101), (3, 0b1100), (3, 0b1000), (3, 0)]
