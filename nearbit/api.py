"""The public functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbit.operators.compare import compare as compare_pairs
from nearbit.operators.strategies import STRATEGIES, Spec
from nearbit.plans import planner

__all__ = ["bits_of", "compare_pairs", "explain_cost", "hamming_self_join", "points_of"]


def points_of(df: DataFrame, value: Column | str, *, bits: int, id: Column | str | None = None) -> DataFrame:
    """``v`` (and ``id``) of the rows; null values are left out, values outside the universe raise."""
    col = F.expr(value) if isinstance(value, str) else value
    ids = [] if id is None else [(F.col(id) if isinstance(id, str) else id).alias("id")]
    raw = df.select(col.cast("bigint").alias("v"), *ids).where("v is not null")
    fits = (F.col("v") >= 0) & (F.col("v") < F.lit(1 << bits))
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"value outside the universe of {bits} bits")).cast("bigint"))
    return raw.select(checked.alias("v"), *(["id"] if ids else []))


def bits_of(df: DataFrame, value: Column | str) -> int:
    """Bits that the largest value needs, 1 at least. Values that are small for their universe make chunks that all share."""
    col = F.expr(value) if isinstance(value, str) else value
    return max(1, int(df.agg(F.max(col.cast("bigint"))).first()[0] or 0).bit_length())


def hamming_self_join(df: DataFrame, value: Column | str, *, d: int, bits: int | None = 32, id: Column | str | None = None, mode: str = "set", strategy: str = "auto", **options) -> DataFrame:
    """All pairs of strings within Hamming distance ``d``, each once.

    mode "set": distinct values, ``(l, r, dist)`` with ``l < r``. mode "bag":
    rows told apart by ``id``, ``(l, r, lid, rid, dist)``, equal values included.
    strategy: a name of STRATEGIES, or "auto" (measures the points to choose).
    bits: the universe; None: as many as the largest value needs (one aggregate).
    Further options go to Spec: grid, residue, chunks, bucket, seed, anchors, complement, reducers, join_hint.
    """
    if mode not in ("set", "bag"):
        raise ValueError("mode is 'set' or 'bag'")
    if mode == "bag" and id is None:
        raise ValueError("bag mode needs an id")
    bits = bits_of(df, value) if bits is None else bits
    spec = Spec(d=d, bits=bits, bag=mode == "bag", **options)
    points = points_of(df, value, bits=bits, id=id if spec.bag else None)
    points = points if spec.bag else points.distinct()
    if strategy == "auto":
        strategy, chosen = planner.choose(planner.measure(points, d, bits), d, bits)
        spec = replace(spec, **{k: v for k, v in chosen.items() if k not in options})
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is 'auto' or one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy][1](points, spec)


def explain_cost(n: int, d: int, bits: int, grid: int = 8) -> dict[str, dict[str, float]]:
    """Estimated rows shipped, candidate pairs and cost of each strategy."""
    return {s: planner.estimate(s, planner.Stats.even(n, d, bits), d, bits, grid) for s in STRATEGIES}
