"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into ``PARTS`` parts; each part is coded by the nearest of
``CENTROIDS`` centroids, fitted on a bounded sample, and its residual's length is
stored. A table of an anchor's products with all centroids gives the score of a
code; the score itself differs by at most the sum of the products of the parts'
lengths with the stored residual norms. What these bounds leave in a window is
scored exactly, and the window's best rows are taken.

An anchor's positives are its best rows of the same label; the window of each is
``low`` to ``high`` of its score, in percent, among rows of other labels.

Rows without a usable vector, without an id, of other lengths, and repeated ones
are treated as :mod:`nearbit.llm.vectors` says; rows without a label take no
part. An anchor without positives, a window without negatives, and an empty
table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import stored
from nearbit.llm.vectors import FIELDS, LEAST, MOST, SLACK, Rows, asking, best, lists, matrix, measure, sample_of, whole

PARTS, CENTROIDS, ROUNDS = 8, 64, 8


class Quantised:
    """Codebooks of the parts, and the bounds that they give."""

    def __init__(self, x: np.ndarray, parts: int = PARTS, centroids: int = CENTROIDS, seed: int = 7) -> None:
        dims = x.shape[1]
        self.cuts = [c for c in np.array_split(np.arange(dims), min(parts, dims))]
        fine = x[np.abs(x).max(axis=1, initial=0) < 1e100]
        fine = fine if len(fine) else np.zeros((1, dims))
        self.books = [self._fit(np.unique(fine[:, c], axis=0), centroids, seed) for c in self.cuts]

    @staticmethod
    def _fit(x: np.ndarray, k: int, seed: int) -> np.ndarray:
        book = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(ROUNDS):
            own = Quantised._nearest(x, book)
            book = np.stack([x[own == c].mean(axis=0) if (own == c).any() else book[c] for c in range(len(book))])
        return book

    @staticmethod
    def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms of the parts; any code is right, the nearest is tight."""
        codes = np.stack([self._nearest(x[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        with np.errstate(all="ignore"):
            left = [np.sqrt(((x[:, c] - b[codes[:, m]]) ** 2).sum(axis=1)) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))]
        return codes.astype(np.uint8), np.stack(left, axis=1)

    def queries(self, x: np.ndarray) -> object:
        with np.errstate(all="ignore"):
            lengths = np.stack([np.sqrt((x[:, c] ** 2).sum(axis=1)) for c in self.cuts], axis=1)
            tables = [x[:, c] @ b.T for c, b in zip(self.cuts, self.books, strict=True)]
            return np.sqrt((x * x).sum(axis=1)), lengths, tables

    def between(self, state: object, q: np.ndarray | slice, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        norm, lengths, tables = state
        codes, left = (rows.codes, rows.residuals) if rows.codes is not None else self.encode(rows.x)
        with np.errstate(all="ignore"):
            sums = sum(t[q][:, codes[:, m]] for m, t in enumerate(tables))
            size = norm[q][:, None] * (rows.norm + np.sqrt((left * left).sum(axis=1)))
            rest = lengths[q] @ left.T + SLACK * size
        return sums - rest, sums + rest

    def closer(self, state: object, q: np.ndarray, rows: Rows, r: np.ndarray) -> None:
        """Stored residual norms have nothing closer."""


def coded(rows: DataFrame, model: Quantised, dims: int) -> DataFrame:
    """``FIELDS`` with ``codes`` (a byte a part) and ``residuals`` (their norms)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, left = shared.value.encode(matrix(b["x"], dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), lists(left)], [*b.schema.names, "codes", "residuals"])

    return rows.mapInArrow(run, f"{FIELDS}, codes binary, residuals array<double>")


def hard_negatives(df: DataFrame, anchors: Column, *, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that ``anchors`` picks."""
    known = df.where(label.isNotNull())
    n, dims = measure(known, embedding)
    ints = whole(known, dims, vec_id=vec_id, embedding=embedding, label=label)
    sample = sample_of(ints, n, dims)
    model = Quantised(matrix(sample["x"].combine_chunks(), dims))
    rows = stored(coded(ints, model, dims), "coded-vectors")
    picked = known.where(anchors & F.col(vec_id).isNotNull())
    asks = asking(whole(picked, dims, vec_id=vec_id, embedding=embedding, label=label))
    size = {"dims": dims, "n": n, "n_queries": picked.count()}
    near = stored(best(asks, rows, sample, model, k=positives, rule="same", **size), "positives")

    # Whole numbers n with low * p <= 100 * n <= high * p, by p = 100 * h + r, so that nothing leaves 64 bits.
    h, r = "(score - pmod(score, 100L)) div 100", "pmod(score, 100L)"
    cut = near.withColumns({"low": F.expr(f"{low} * ({h}) + ({low} * {r} + 99) div 100"), "high": F.expr(f"{high} * ({h}) + ({high} * {r}) div 100")})
    windows = cut.groupBy(F.col("query_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # ``positives`` at most
    padded = lambda name, fill: F.concat(F.col("w")[name], F.array_repeat(F.lit(fill).cast("long"), F.lit(positives) - F.size("w")))
    anchored = asks.drop("lows", "highs").join(windows.hint("merge"), "vec_id").withColumns({"lows": padded("low", MOST), "highs": padded("high", LEAST)}).drop("w")
    far = best(anchored, rows, sample, model, k=negatives, rule="different", windows=positives, **size)
    far = far.select(F.col("query_id").alias("anchor_id"), (F.col("slot") + 1).alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    to = near.select(F.col("query_id").alias("anchor_id"), F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(to.hint("merge"), ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
