"""Hot buckets, cells, balls from ranks, nearest anchors by growing distance, bitmaps, coverage, and what runs really do."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from nearbit import hamming_self_join
from nearbit.functions import bits as B
from nearbit.operators import anchors, balls, cells
from nearbit.operators import strategies as S
from nearbit.plans import planner
from nearbit.sources import writers


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")


def brute(values, d):
    values = sorted(set(values))
    return Counter((a, b, (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= d)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# Hot buckets


def test_small_ids_put_no_bucket_under_one_key(spark):
    """20,000 ids in 32 bits share their upper half: one bucket of 20,000 before, none beyond about twice the bound after."""
    points, spec = spark.range(20_000).select(F.col("id").alias("v")), S.Spec(d=1)
    got = S.split_candidates(points, spec)
    assert cells.heavy_buckets(got, ["j", "k"], spec.bucket).collect()[0]["n"] == 20_000
    cut = cells.split_buckets(got, ["j", "k"], [], spec.bucket)
    largest = cut.groupBy("j", "k", "lo", "hi").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 2.2 * spec.bucket
    joined = S.split_pairs(points, spec)
    assert joined.count() == S.ball_full_pairs(points, spec).count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [j" in plan and "lo#" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("d", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket", [1, 3, 20])
def test_cut_buckets_find_every_pair_once(spark, d, bucket):
    values = [3 * i for i in range(60)] + random.Random(d).sample(range(4096), 40)
    df = frame(spark, values)
    assert rows(hamming_self_join(df, "v", d=d, bits=12, strategy="split", bucket=bucket)) == brute(values, d)


def test_cut_buckets_of_copies(spark):
    """Copies of one value are told apart by id, and spread over the bands of their bucket."""
    values = [5] * 40 + [4] * 7 + [1000]
    df = frame(spark, values)
    got = rows(hamming_self_join(df, "v", d=1, bits=12, id="id", mode="bag", strategy="split", bucket=5))
    want = Counter((a, b, i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if (a, i) < (b, j) and (a ^ b).bit_count() <= 1)
    assert got == want
    cut = cells.split_buckets(S.split_candidates(df, S.Spec(d=1, bits=12, bag=True)), ["j", "k"], ["id"], 5)
    assert cut.groupBy("j", "k", "lo", "hi").count().agg(F.max("count")).first()[0] < 25


def test_grid_of_multiples_is_even(spark):
    points = spark.range(4_000).select((F.col("id") * 8).alias("v"))
    for bag, ids in ((False, points), (True, points.withColumn("id", F.col("v")).withColumn("v", F.lit(7).cast("bigint")))):
        sizes = [r["count"] for r in S.grid_candidates(ids, S.Spec(d=2, bits=16, grid=8, bag=bag)).groupBy("lo", "hi").count().collect()]
        assert len(sizes) == 36 and max(sizes) < 1.5 * 4_000 * 2 / 8
    by_residue = S.grid_candidates(points, S.Spec(d=2, bits=16, grid=8, residue=True)).groupBy("lo", "hi").count().agg(F.max("count")).first()[0]
    assert by_residue == 4_000


def test_given_chunks(spark):
    values = random.Random(3).sample(range(1 << 12), 120)
    striped = tuple(sum(1 << i for i in range(j, 12, 3)) for j in range(3))
    assert rows(hamming_self_join(frame(spark, values), "v", d=2, bits=12, strategy="split", chunks=striped)) == brute(values, 2)
    for wrong in ((1, 2), (0xFF0, 0x0FF, 0x000), striped[:2]):
        with pytest.raises(ValueError):
            S.Spec(d=2, bits=12, chunks=wrong)


# The planner


def test_measured_choice(spark, monkeypatch):
    """The cheaper strategy on even, dense and skewed values; bits that never vary make no chunk of their own."""
    monkeypatch.setattr(planner, "SMALL", 1_000)
    even = spark.range(6_000).select(B.scatter(F.col("id"), 32, 1).alias("v"))
    dense = spark.range(6_000).select(F.col("id").alias("v"))
    skewed = spark.range(6_000).select((F.col("id") % 4096 + F.when(F.col("id") < 4096, 0).otherwise(1 << 31)).alias("v"))
    for points, d in ((even, 1), (even, 2), (dense, 1), (skewed, 1), (skewed, 2)):
        stats = planner.measure(points, d, 32)
        name, options = planner.choose(stats, d, 32)
        counters = {}
        for way, more in (("split", {"chunks": stats.layouts["runs"].masks}), ("split", {"chunks": stats.layouts["dealt"].masks}), ("ball_half", {}), ("ball_full", {})):
            seen = S.Counters()
            writers.discard(S.STRATEGIES[way][1](points, S.Spec(d=d, bits=32, counters=seen, bucket=10**9, **more)))
            counts = seen.counts()
            counters[way, more.get("chunks")] = planner.SHIP_COST * planner.shipped_rows(way, 6_000, d, 32) + counts["candidates"] / (1 if way == "ball_full" else 2)
        best = min(counters.values())
        assert counters[name, options.get("chunks")] <= 1.5 * best, (name, counters)
    dealt = planner.measure(dense, 1, 32).layouts
    assert dealt["runs"].largest == 6_000 and dealt["dealt"].largest <= 6_000 / 32
    assert planner.measure(dense, 1, 32).shares[31] == 0


def test_dealt_chunks_share_the_bits():
    for shares, parts in (([0.5] * 9, 4), ([0.0] * 20 + [0.5] * 12, 3), ([0.1, 0.9, 0.5], 5)):
        masks = B.dealt_chunks(shares, parts)
        assert sum(masks) == (1 << len(shares)) - 1 and all(masks) and len(masks) == min(parts, len(shares))
        assert not any(a & b for a, b in combinations(masks, 2))
    masks = B.dealt_chunks([0.0] * 20 + [0.5] * 12, 3)
    assert [(m >> 20).bit_count() for m in masks] == [4, 4, 4]


def test_distances_of_pairs():
    stats = planner.Stats(100, (0.5,) * 8)
    assert [round(256 * p, 6) for p in stats.apart()] == [1, 8, 28, 56, 70, 56, 28, 8, 1]
    for bits, apart, radius in ((6, 0, 1), (6, 2, 1), (6, 2, 2), (6, 3, 2), (6, 5, 2)):
        other = (1 << apart) - 1
        assert planner.common_centres(bits, apart, radius) == sum(c.bit_count() <= radius and (c ^ other).bit_count() <= radius for c in range(1 << bits))


# Balls


@pytest.mark.parametrize("bits,radius,lowest", [(5, 2, 0), (9, 4, 1), (9, 3, 3), (6, 6, 0), (4, 0, 0), (4, 0, 1), (32, 2, 0)])
def test_masks_from_ranks(spark, monkeypatch, bits, radius, lowest):
    """As a literal, as a broadcast table and as blocks."""
    points, want = frame(spark, [0, 3, 7]).select("v"), Counter((v, m) for v in (0, 3, 7) for m in B.masks(bits, radius, lowest))
    assert [r["mask"] for r in balls.mask_table(spark, bits, radius, lowest).orderBy("id").collect()] == B.masks(bits, radius, lowest)
    assert rows(balls.with_masks(points, bits, radius, lowest)) == want
    monkeypatch.setattr(balls, "INLINE_MASKS", 0)
    assert rows(balls.with_masks(points, bits, radius, lowest)) == want
    monkeypatch.setattr(balls, "MASK_LIMIT", 0)
    monkeypatch.setattr(balls, "BLOCK", 7)
    assert rows(balls.with_masks(points, bits, radius, lowest)) == want


def test_large_ball_needs_no_list_on_the_driver(spark, monkeypatch):
    """15,033,173 masks of up to 8 of 32 bits, of which a few ranks are looked at, while the driver may list none."""
    monkeypatch.setattr(B, "masks", lambda *a: pytest.fail("listed on the driver"))
    around = balls.with_masks(spark.createDataFrame([(5,)], "v long"), 32, 8, 0)
    assert "Broadcast" not in around._jdf.queryExecution().executedPlan().toString()
    table = balls.mask_table(spark, 32, 8, 0)
    assert balls.mask_count(32, 8, 0) == 15_033_173
    last = table.where("id >= 15033170").orderBy("id").collect()
    assert [r["mask"].bit_count() for r in last] == [8, 8, 8] and last[-1]["mask"] == 0xFF000000
    assert table.where("id < 33").agg(F.sum("mask")).first()[0] == (1 << 32) - 1


# Anchors


@pytest.mark.parametrize("bits", [24, 32])
def test_nearest_of_many_anchors(spark, bits):
    """More anchors than are scanned, no bound on the distance."""
    held = spark.range(70_000).select(B.scatter(F.col("id"), bits, 9).alias("c"))
    values = [r.v for r in spark.range(60).select(B.scatter(F.col("id") + 5_000_000, bits, 4).alias("v")).collect()]
    c = [r.c for r in held.collect()]
    want = Counter((v, *min(((v ^ x).bit_count(), x) for x in c)[::-1]) for v in values)
    assert rows(S.anchor_home(frame(spark, values), held, bits=bits)) == want
    near_only = Counter({k: n for k, n in want.items() if k[2] <= 5})
    assert rows(S.anchor_home(frame(spark, values), held, bits=bits, d=5)) == near_only


def test_ways_by_counts(spark, monkeypatch):
    points = frame(spark, list(range(300))).select("v")
    few, many = (anchors.AnchorSet(spark.range(n).select(F.col("id").alias("c"))) for n in (10, 1_000))
    assert anchors.way(few, points, 32, 4) == "scan"
    monkeypatch.setattr(anchors, "SCAN_LIMIT", 100)
    assert anchors.way(many, points, 32, 6) == "cells"
    assert anchors.way(many, points, 16, 1) == "expand"
    assert anchors.way(anchors.AnchorSet(many.table, True), points, 32, 6) == "expand"
    monkeypatch.setattr(cells, "BAND", 40)
    values = random.Random(8).sample(range(1 << 32), 150) + [1, 2, 4, 7, 2**31, 2**31 + 1]
    assert rows(hamming_self_join(frame(spark, values), "v", d=4, strategy="anchor")) == brute(values, 4)


def test_bitmaps(spark, monkeypatch):
    """What a set has or lacks is found without an exchange of the rows."""
    values = [0, 1, 7, 8, 32767, 32768, 32769, 65535, 65536, 2**31, 2**32 - 1]
    held = spark.createDataFrame([(v,) for v in values[::2]], "c long")
    points = frame(spark, values).select("v")
    for few, most in ((10**6, 4096), (0, 4096), (0, 2)):
        monkeypatch.setattr(anchors, "FEW", few)
        monkeypatch.setattr(anchors.bitmaps, "__defaults__", ("c", most))
        for complement in (False, True):
            kept = anchors.AnchorSet(held, complement).keep(points, "v")
            assert sorted(r.v for r in kept.collect()) == values[1::2] if complement else values[::2]
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 2)


def test_covering_needs_fewer_anchors_than_points(spark):
    rng = random.Random(6)
    centres = [rng.randrange(1 << 32) for _ in range(120)]
    values = sorted({c ^ (1 << rng.randrange(32)) for c in centres for _ in range(25)})
    points = frame(spark, values).select("v")
    got = [r.c for r in anchors.covering(points, 32, 2, 17, bound=20).collect()]
    assert len(got) < len(values) / 4 and set(got) <= set(values)
    assert all(any((v ^ c).bit_count() <= 2 for c in got) for v in values)
    assert rows(hamming_self_join(points, "v", d=2, strategy="anchor")) == brute(values, 2)


# What runs really do


@pytest.mark.parametrize("strategy", ["split", "grid", "ball_half", "ball_full"])
def test_counters(spark, strategy):
    values = random.Random(1).sample(range(1024), 100)
    seen = S.Counters()
    got = S.STRATEGIES[strategy][1](frame(spark, values).select("v"), S.Spec(d=2, bits=10, grid=4, counters=seen)).collect()
    counts = seen.counts()
    assert counts["pairs"] == len(got) == sum(brute(values, 2).values())
    assert counts["candidates"] >= counts["pairs"] and counts["shipped"] > 0


@pytest.mark.parametrize("strategy,keys", [("split", ["j", "k"]), ("grid", ["lo", "hi"]), ("ball_half", ["centre"]), ("ball_full", ["centre"])])
def test_exchanged_is_what_is_counted(spark, strategy, keys):
    points, spec = frame(spark, random.Random(2).sample(range(1024), 100)).select("v"), S.Spec(d=2, bits=10, grid=5)
    got = writers.exchanged(S.STRATEGIES[strategy][0](points, spec), *keys, partitions=3).first()
    assert got["n_rows"] == writers.count_shipped(points, strategy, spec).first()[0] and got["n_bytes"] > 0
