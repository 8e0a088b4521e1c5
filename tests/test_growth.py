"""What the joins send, look at and hold as inputs grow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearbit import hamming_self_join
from nearbit.functions import bits as B
from nearbit.operators import anchors as A
from nearbit.operators import strategies as S


def brute(values, d):
    values = sorted(set(values))
    return Counter((a, b, (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= d)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_far_anchors_send_no_members(spark, monkeypatch):
    """32 bits and distance 6 sent each value once for each anchor within 12."""
    near, reach = A.near, []
    monkeypatch.setattr(A, "near", lambda points, anchors, bits, radius, how: reach.append(radius) or near(points, anchors, bits, radius, how))
    rng = random.Random(4)
    values = [rng.randrange(1 << 32) for _ in range(150)]
    values += [v ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for v in values[:60]]
    assert rows(hamming_self_join(frame(spark, values), "v", d=6, strategy="anchor")) == brute(values, 6)
    assert max(reach, default=0) <= 6


@pytest.mark.parametrize("bits", [32, 12])
def test_members_of_dense_values_do_not_travel(spark, bits):
    """F2 in 32 bits, F6 in as many as the values need: the members, most of the rows, were sorted and sent to their homes."""
    points = spark.range(4_000).select(F.col("id").alias("v"))
    got = S.anchor_pairs(points, S.Spec(d=2, bits=bits))
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
    assert rows(got) == rows(S.ball_full_pairs(points, S.Spec(d=2, bits=12)))


def test_hot_buckets_are_split_again(spark):
    """a bucket of n rows in n / 150 bands sent each row n / 150 times."""
    points, sent = spark.range(20_000).select(F.col("id").alias("v")), []
    for n in (5_000, 20_000):
        seen = S.Counters()
        got = S.split_pairs(points.where(F.col("v") < n), S.Spec(d=2, bucket=150, counters=seen)).count()
        assert got == seen.counts()["pairs"] == S.ball_full_pairs(points.where(F.col("v") < n), S.Spec(d=2)).count()
        sent.append(seen.counts()["shipped"] / n)
    assert sent[1] < 40 and sent[1] < 2 * sent[0]


@pytest.mark.parametrize("strategy", ["nested_loop", "split"])
def test_copies_are_joined_as_one(spark, monkeypatch, strategy):
    """rows that share a value were compared, and cut into bands, one by one."""
    monkeypatch.setattr(S, "COPIES", 7)
    values = [v for v in (3, 5, 6, 200) for _ in range(30)] + list(range(40, 60))
    df, seen = frame(spark, values), S.Counters()
    want = Counter((a, b, i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if (a, i) < (b, j) and (a ^ b).bit_count() <= 2)
    assert rows(hamming_self_join(df, "v", d=2, bits=8, id="id", mode="bag", strategy=strategy, bucket=3, counters=seen)) == want
    assert seen._seen["pairs"].get["n"] == sum(brute(values, 2).values())


@pytest.mark.parametrize("d,times", [(3, 3), (6, 12)])
def test_half_balls_of_dense_values(spark, d, times):
    """F7, F8: both sides sent the whole half ball, and a centre met all its values with one another."""
    points, seen = spark.range(1 << 10).select(F.col("id").alias("v")), S.Counters()
    got = S.ball_half_pairs(points, S.Spec(d=d, bits=10, counters=seen)).count()
    counts = seen.counts()
    assert got == 1024 * B.ball_size(10, d) // 2
    assert counts["candidates"] < times * got and counts["shipped"] < 1024 * B.ball_size(10, (d + 1) // 2)


def test_gathered_bits(spark):
    for mask, rest in ((0b1011011, 0b100), (0, 9), (0xFFFFFFFF, 0), (0xF0F00000, 0x0000FFFF)):
        values = [rest | mask, rest, rest | (mask & 0x5A5A5A5A)]
        got = frame(spark, values).select("v", B.gathered(F.col("v"), mask).alias("g")).withColumn("back", B.spread(F.col("g"), mask, rest)).collect()
        assert all(r.back == r.v and r.g < 1 << mask.bit_count() for r in got)
