import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearbit import compare_pairs, explain_cost, hamming_self_join
from nearbit.__main__ import main
from nearbit.api import bits_of
from nearbit.functions import bits as B
from nearbit.operators import anchors
from nearbit.operators.strategies import STRATEGIES, Spec, anchor_home
from nearbit.plans import planner
from nearbit.sources.generators import universe_full, universe_sample


def brute(values, d):
    values = sorted(set(values))
    return {(a, b, (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= d}


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("d", [0, 1, 2, 3, 4, 9])
def test_all_pairs_once(spark, strategy, d):
    values = random.Random(d).sample(range(512), 90)
    got = hamming_self_join(frame(spark, values), "v", d=d, bits=9, strategy=strategy, grid=4).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(values, d)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_bag_counts_copies(spark, strategy):
    values = [3, 3, 3, 2, 2, 12, 3]
    got = [tuple(r) for r in hamming_self_join(frame(spark, values), "v", d=1, bits=5, id="id", mode="bag", strategy=strategy, grid=3).collect()]
    want = []
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            if (a, i) < (b, j) and (a ^ b).bit_count() <= 1:
                want.append((a, b, i, j, (a ^ b).bit_count()))
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("d,n", [(1, 5120), (2, 28160)])
def test_full_universe(spark, d, n):
    assert hamming_self_join(universe_full(spark, 10), "v", d=d, bits=10, strategy="split").count() == n


@pytest.mark.parametrize("strategy", ["nested_loop", "grid", "ball_half", "split", "anchor", "ball_full"])
def test_top_bit(spark, strategy):
    values = [2**31, 2**31 + 1, 2**32 - 1, 1, 0, 2**32 - 2]
    got = hamming_self_join(frame(spark, values), "v", d=1, bits=32, strategy=strategy)
    assert {tuple(r) for r in got.collect()} == brute(values, 1)


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("values", [[], [7], [7, 7, 7], [None, 5, 4]])
def test_edges(spark, strategy, values):
    got = hamming_self_join(frame(spark, values), "v", d=1, bits=4, strategy=strategy)
    assert {tuple(r) for r in got.collect()} == brute([v for v in values if v is not None], 1)


@pytest.mark.parametrize("bits,d", [(5, 1), (9, 2), (9, 4)])
def test_given_anchors_and_what_they_lack(spark, bits, d):
    values = random.Random(d).sample(range(1 << bits), 30)
    held = spark.createDataFrame([(c,) for c in random.Random(3).sample(range(1 << bits), 12)], "c long")
    for complement in (False, True):
        got = hamming_self_join(frame(spark, values), "v", d=d, bits=bits, strategy="anchor", anchors=held, complement=complement)
        assert Counter(tuple(r) for r in got.collect()) == Counter(brute(values, d))


def test_anchor_ways_agree(spark, monkeypatch):
    values = random.Random(2).sample(range(4096), 150)
    points = frame(spark, values).select("v")
    given = spark.createDataFrame([(c,) for c in random.Random(9).sample(range(4096), 60)], "c long")
    scanned = Counter(tuple(r) for r in anchors.near(points, anchors.AnchorSet(given), 12, 4, "scan").collect())
    assert scanned == Counter(tuple(r) for r in anchors.near(points, anchors.AnchorSet(given), 12, 4, "expand").collect())
    lacking = universe_full(spark, 12).select(F.col("v").alias("c")).join(given, "c", "left_anti")
    assert scanned == Counter(tuple(r) for r in anchors.near(points, anchors.AnchorSet(lacking, True), 12, 4, "expand").collect())
    first = sorted(tuple(r) for r in anchor_home(points, given, bits=12).collect())
    c = [r.c for r in given.collect()]
    assert first == sorted((v, *min(((v ^ x).bit_count(), x) for x in c)[::-1]) for v in values)
    met = Counter(tuple(r) for r in anchors.near(points, anchors.AnchorSet(given), 12, 4, "cells").collect())
    assert scanned == met
    monkeypatch.setattr(anchors, "SCAN_LIMIT", 10)
    assert first == sorted(tuple(r) for r in anchor_home(points, given, bits=12).collect())
    assert anchor_home(points, given.where("false"), bits=12).count() == 0


def test_no_nested_loop_over_more_anchors_than_are_scanned(spark, capsys, monkeypatch):
    monkeypatch.setattr(anchors, "SCAN_LIMIT", 2)
    hamming_self_join(frame(spark, [1, 2, 3]), "v", d=1, bits=32, strategy="anchor").explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_anchor_sizes():
    assert anchors.sizing(16, 1) == {"anchors": 65536, "complement": True, "held": 0, "mode": "expand"}
    assert anchors.target(16, 2) == 8673 and anchors.mode(8673, 16, 2) == "expand"
    assert anchors.target(16, 3) == 1695 and anchors.mode(1695, 16, 3) == "scan"
    assert anchors.sizing(5, 2) == {"anchors": 23, "complement": True, "held": 9, "mode": "expand"}
    assert anchors.sizing(32, 1)["held"] == 0


def test_scatter_is_a_permutation(spark):
    for bits in (0, 1, 2, 7, 12):
        got = [r.v for r in spark.range(1 << bits).select(B.scatter(F.col("id"), bits, 5).alias("v")).collect()]
        assert sorted(got) == list(range(1 << bits))
    got = [r.v for r in universe_sample(spark, 16, 32, seed=3).collect()]
    steps = Counter((a ^ b).bit_count() for a, b in zip(got, got[1:]))
    assert max(steps.values()) < len(got) / 3  # neighbours in the draw are far apart in many ways


def test_reducers_and_measured_bits(spark, capsys):
    values = random.Random(1).sample(range(300), 80)
    df = frame(spark, values)
    for strategy in ("split", "ball_half", "grid"):
        got = hamming_self_join(df, "v", d=1, bits=None, strategy=strategy, reducers=9)
        assert {tuple(r) for r in got.collect()} == brute(values, 1) and got.rdd.getNumPartitions() == 9
    assert bits_of(df, "v") == max(values).bit_length() and bits_of(df.where("false"), "v") == 1
    placed = spark.range(20).select(B.reducer_of_chunk(F.col("id"), F.lit(1), 3, 5).alias("r")).collect()
    assert [r.r for r in placed] == [(3 * i + 1) % 5 for i in range(20)]


def test_command_line(spark, tmp_path, capsys):
    p = str(tmp_path)
    assert main(["--verbose", "generate-part", "10", "4", f"{p}/in"], spark) == 0
    for name, rest in (("naive", ["4"]), ("ball-half", ["3", "10"]), ("ball-full", ["3", "10"]), ("split", ["3", "10"]), ("anchor", ["3", "10"]), ("auto", ["3", "10"])):
        main([name, f"{p}/in", f"{p}/{name}", "2", *rest], spark)
        main(["compare", f"{p}/naive", f"{p}/{name}", f"{p}/diff-{name}", "2"], spark)
        assert spark.read.text(f"{p}/diff-{name}").count() == 0
    main(["split", f"{p}/in", f"{p}/one", "1", "3", "10"], spark)
    main(["compare", f"{p}/one", f"{p}/split", f"{p}/diff", "2"], spark)
    lines = [r.value for r in spark.read.text(f"{p}/diff").collect()]
    assert lines and all(x.startswith("missing_in_first (1)\t") and len(x.split("\t")[1]) == 65 for x in lines)
    capsys.readouterr()
    main(["split", f"{p}/in", "null", "2", "3", "10"], spark)
    main(["split", f"{p}/in", "null-cost", "2", "3", "10"], spark)
    main(["split", f"{p}/in", "null-absolute", "2", "3", "10"], spark)
    found = spark.read.text(f"{p}/split").count()
    assert capsys.readouterr().out.split() == ["768", str(found)]
    main(["generate-full", "4", f"{p}/full"], spark)
    main(["--split-bytes", "4096", "naive", f"{p}/full", "null", "1", "2"], spark)
    for wrong in (["naive", "a", "b", "1"], ["split", "a", "b", "1", "2"], ["split", "a", "b", "-1", "2", "8"], ["split", "a", "b", "1", "2", "40"], ["naive", "a", "b", "1", "0"], []):
        with pytest.raises(SystemExit):
            main(wrong, spark)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_compare_in_given_partitions(spark):
    a, b = pairs(spark, [(1, 3), (3, 1), (1, 5), (2, 4)]), pairs(spark, [(1, 3), (2, 6), (2, 6)])
    want = sorted(tuple(r) for r in compare_pairs(a, b).collect())
    assert sorted(tuple(r) for r in compare_pairs(a, b, reducers=3).collect()) == want


def test_few_anchors_stay_exact(spark):
    values = random.Random(1).sample(range(1024), 120)
    one = spark.createDataFrame([(0,)], "c long")
    got = hamming_self_join(frame(spark, values), "v", d=2, bits=10, strategy="anchor", anchors=one)
    assert {tuple(r) for r in got.collect()} == brute(values, 2)


def test_outside_the_universe_raises(spark):
    with pytest.raises(Exception, match="outside the universe"):
        hamming_self_join(frame(spark, [1, 16]), "v", d=1, bits=4, strategy="split").collect()


def test_bad_arguments(spark):
    df = frame(spark, [1])
    for wrong in ({"d": -1}, {"d": 1, "bits": 40}, {"d": 1, "mode": "list"}, {"d": 1, "mode": "bag"}, {"d": 1, "strategy": "guess"}, {"d": 1, "grid": 0}):
        with pytest.raises(ValueError):
            hamming_self_join(df, "v", **{"strategy": "split", **wrong})


def test_planner():
    even = planner.Stats.even
    assert planner.choose(even(100, 2, 32), 2, 32)[0] == "nested_loop"
    assert planner.choose(even(10**9, 1, 32), 1, 32)[0] in ("split", "ball_half", "ball_full")
    assert planner.choose(even(10**6, 0, 32), 0, 32)[0] in ("split", "ball_half", "ball_full")
    assert set(explain_cost(1000, 2, 16)) == set(STRATEGIES)


def test_shipped_rows(spark):
    points = universe_full(spark, 8)
    for name in ("grid", "split", "ball_half", "ball_full"):
        shipped = STRATEGIES[name][0](points, Spec(d=2, bits=8, grid=5)).count()
        assert shipped == planner.shipped_rows(name, 256, 2, 8, grid=5)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "l long, r long")


@pytest.mark.parametrize(
    "first,second,want",
    [
        ([(1, 3)], [(3, 1)], []),
        ([(1, 3), (1, 5)], [(1, 3)], [("missing_in_second", 1, 5, 1)]),
        ([(1, 3)], [(1, 3), (1, 5)], [("missing_in_first", 1, 5, 1)]),
        ([(1, 3), (3, 1)], [(1, 3)], [("duplicate_in_first", 1, 3, 2)]),
        ([(1, 3)], [(1, 3), (2, 6), (2, 6)], [("duplicate_in_second", 2, 6, 2), ("missing_in_first", 2, 6, 2)]),
        ([(0, 2**31)], [(2**31, 0)], []),
    ],
)
def test_compare(spark, first, second, want):
    assert sorted(tuple(r) for r in compare_pairs(pairs(spark, first), pairs(spark, second)).collect()) == want


def test_generators(spark):
    assert [r.v for r in universe_full(spark, 0).collect()] == [0]
    got = [r.v for r in universe_sample(spark, 12, 8).collect()]
    assert len(got) == len(set(got)) == 512 and max(got) < 4096
    assert got == [r.v for r in universe_sample(spark, 12, 8).collect()]
    assert got != [r.v for r in universe_sample(spark, 12, 8, seed=1).collect()]


def test_text_and_sequence_files(spark, tmp_path):
    from nearbit.sources import readers, writers

    values = [0, 5, 2**31, 2**32 - 1]
    df = frame(spark, values).select("v")
    writers.write_sequence(df, f"{tmp_path}/seq")
    assert sorted(r.v for r in readers.sequence_points(spark, f"{tmp_path}/seq").collect()) == values
    joined = hamming_self_join(df, "v", d=2, strategy="split")
    writers.write_text(joined, f"{tmp_path}/text")
    assert compare_pairs(joined, readers.text_pairs(spark, f"{tmp_path}/text")).count() == 0
    writers.discard(joined)
    assert writers.count_pairs(joined).first().n_pairs == joined.count()
    assert writers.rendered(joined).where(F.length("l") != 32).count() == 0
    assert B.WORD == 32
