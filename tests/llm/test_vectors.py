"""Top-k and hard negatives against brute force in whole numbers, on odd rows and on empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nearbit.llm import negatives, queries, topk, vectors
from nearbit.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string, tag string"
LEAST, MOST = -(2**63), 2**63 - 1


def usable(x):
    return x is not None and all(e is not None and math.isfinite(e) and math.isfinite(256 * e) for e in x)


def product(a, b):
    s = sum(math.floor(256 * p) * math.floor(256 * q) for p, q in zip(a, b, strict=False))
    return max(min(s, MOST), LEAST + 1)


def asks(rows, every):
    """Of rows that share an id the smallest asks."""
    out = {}
    for i, x, lab in rows:
        if i is not None and i % every == 0 and usable(x):
            ints = [math.floor(256 * e) for e in x] + [0] * 64
            if i not in out or ((lab if lab is not None else -1, ints) < out[i][0]):
                out[i] = ((lab if lab is not None else -1, ints), x, lab)
    return {i: (x, lab) for i, (_, x, lab) in out.items()}


def ordered(found):
    return sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))


def top_brute(rows, every=50, k=5):
    out = []
    for q, (x, _) in asks([(i, x, None) for i, x, _ in rows], every).items():
        found = ordered([(i, product(x, y)) for i, y, _ in rows if usable(y) and i != q])
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(found[:k])]
    return out


def hard_brute(rows, every=100):
    rows = [(i, x, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, x, lab in rows if lab is not None and usable(x)]
    out = []
    for q, (x, lab) in asks(rows, every).items():
        scored = [(i, product(x, y), mark) for i, y, mark in rows if i != q]
        near = ordered([(i, s) for i, s, mark in scored if mark == lab])[:5]
        for p, ps in near:
            found = ordered([(i, s) for i, s, mark in scored if mark != lab and 30 * ps <= 100 * s <= 90 * ps])
            out += [(q, p, r + 1, i, ps, s) for r, (i, s) in enumerate(found[:10])]
    return out


def flipped():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def run_top(df, every=50):
    return [tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0).collect()]


def run_hard(df, every=100):
    return [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0, label=flipped()).collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, lab, "s", "r", "t") for i, x, lab in rows], SCHEMA)


def made(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [spread * rng.lognormvariate(0, 1) * (c + rng.gauss(0, 0.5)) for c in centres[i % 4]], i % 4 if rng.random() < 0.8 else rng.randrange(10)) for i in range(n)]


def key(rows):
    return sorted(rows, key=str)


def test_lengths_and_ties(spark):
    """Vectors of very different lengths, ties by copies under other ids, few whole values."""
    rows = made(400, 12, 1) + [(1000 + i, [1.0, 0.0, -1.0] * 4, i % 3) for i in range(40)] + [(2000 + i, [round(random.Random(i).random(), 1)] * 12, i % 10) for i in range(60)]
    df = frame(spark, rows)
    assert key(run_top(df)) == key(top_brute(rows))
    assert key(run_hard(df)) == key(hard_brute(rows))


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, no id, repeated rows, shared ids, empty and shorter vectors, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = made(150, 5, 2)
    rows += [(300, None, 1), (350, [1.0, None, 1.0], 1), (400, [nan] * 5, 1), (450, [inf, 0.0], 1), (500, [], 1), (550, [1.0], 1), (600, [1.0, -2.0], None), (None, [9.0] * 5, 1), (None, [9.0] * 5, 1), (None, [9.0] * 5, 2)]
    rows += [(700, [1e30, 1.0, 0.0, 0.0, 0.0], 3), (701, [1e30, -1.0, 0.0, 0.0, 0.0], 3), (702, [-1e30, 2.0, 0.0, 0.0, 0.0], 4), (800, [1e300] * 5, 3), (801, [3e7, 3e7, 1.0, 0.0, 0.0], 5), (850, [3e7, 3e7, 3.0, 0.0, 0.0], 5)]
    rows += [(100, [0.5] * 5, 2), (100, [0.25] * 5, 2), (900, [-0.5] * 5, 2), (900, [-0.5] * 5, 2), (3, [0.1] * 5, 3), (3, [0.1] * 5, 3)]
    df = frame(spark, rows)
    assert key(run_top(df)) == key(top_brute(rows))
    assert key(run_hard(df)) == key(hard_brute(rows))


def test_none(spark):
    none = frame(spark, [(1, [1.0], 1)]).where("false")
    assert run_top(none) == [] and run_hard(none) == []
    alone = frame(spark, [(100, [1.0], 1)])
    assert run_top(alone) == [] and run_hard(alone) == []
    assert run_top(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []  # none asks
    assert run_hard(frame(spark, [(100, [1.0], 1), (1, [1.0], 2)])) == []  # no positive


def test_small_blocks(spark, monkeypatch):
    """Many blocks of queries, groups, slices and a sample of a few rows give the same."""
    rows = made(300, 9, 3, spread=0.3)
    df = frame(spark, rows)
    for name, value in (("QUERIES", 3), ("ROWS", 50), ("CELLS", 64), ("SAMPLE_CELLS", 9 * 64)):
        monkeypatch.setattr(vectors, name, value)
    assert key(run_top(df, 10)) == key(top_brute(rows, 10))
    assert key(run_hard(df, 10)) == key(hard_brute(rows, 10))


@pytest.mark.parametrize("name, brute", [("op12_top_k", top_brute), ("op13_hard_negatives", hard_brute)])
def test_queries(spark, small, name, brute):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, small, "embeddings").collect()]
    got = queries.QUERIES[name](spark, small)
    assert key(map(tuple, got.collect())) == key(brute(rows))


def test_bounds_hold():
    """Every score lies between the bounds, and the bounds leave less than all."""
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (6, 32))
    x = np.floor(centres[rng.integers(0, 6, 500)] + rng.normal(0, 12, (500, 32)))
    norm = np.sqrt((x * x).sum(axis=1))
    rows = vectors.Rows(np.arange(500), np.zeros(500, bool), np.zeros(500, int), x, norm)
    true = x[:20] @ x.T
    for bounds in (topk.Rotated(x, (4, 12)), negatives.Quantised(x)):
        state = bounds.queries(x[:20])
        lo, hi = bounds.between(state, slice(None), rows)
        assert (lo <= true).all() and (true <= hi).all()
        assert (hi < np.sort(true, axis=1)[:, -5:-4]).mean() > 0.3
        q, r = np.nonzero(np.abs(true) > 1e5)
        if closer := bounds.closer(state, q[:300], rows, r[:300]):
            assert (closer[0] <= true[q[:300], r[:300]]).all() and (closer[1] >= true[q[:300], r[:300]]).all()
