"""Exact top-k by inner product, with norms and rotated partial sums.

A rotation, fitted by the singular vectors of a bounded sample, brings most of
the vectors' lengths into the first coordinates. Rows come by descending length;
a query is done when the product of lengths falls below its k-th best score. Of
the others a partial sum over ``HEADS`` coordinates plus the product of what
lies beyond (Cauchy and Schwarz) bounds the score; what may still enter is
scored exactly. Any rotation gives the same result, a good one is faster.

Rows without a usable vector, without an id, of other lengths, and repeated ones
are treated as :mod:`nearbit.llm.vectors` says; an empty table, or one without
queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbit.llm.vectors import SLACK, Rows, asking, best, matrix, measure, sample_of, whole

#: Coordinates of the first and of the second partial sum.
HEADS = (8, 32)


class Rotated:
    """Partial sums over the first rotated coordinates, and what lies beyond."""

    def __init__(self, x: np.ndarray, heads: tuple[int, ...] = HEADS) -> None:
        dims = x.shape[1]
        self.heads = sorted({min(h, dims) for h in heads})
        fine = x[np.abs(x).max(axis=1, initial=0) < 1e100]
        _, _, axes = np.linalg.svd(fine, full_matrices=False) if len(fine) else (0, 0, np.zeros((0, dims)))
        self.axes = np.ascontiguousarray(axes[: self.heads[-1]].T)

    def _parts(self, x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        with np.errstate(all="ignore"):
            y = x @ self.axes
            beyond = {h: np.sqrt(np.maximum(norm**2 - (y[:, :h] ** 2).sum(axis=1), 0) + 1e-12 * norm**2) for h in self.heads}
        return y, beyond

    def queries(self, x: np.ndarray) -> object:
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
        return norm, *self._parts(x, norm)

    def between(self, state: object, q: np.ndarray | slice, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        norm, y, beyond = state
        self.seen = rows, self._parts(rows.x, rows.norm)
        z, more = self.seen[1]
        h = self.heads[0]
        with np.errstate(all="ignore"):
            sums = y[q, :h] @ z[:, :h].T
            rest = beyond[h][q][:, None] * more[h] + SLACK * norm[q][:, None] * rows.norm
        return sums - rest, sums + rest

    def closer(self, state: object, q: np.ndarray, rows: Rows, r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        h = self.heads[-1]
        if len(self.heads) == 1 or 8 * len(q) > len(np.unique(q)) * len(rows):  # too many: whole sums cost less
            return None
        norm, y, beyond = state
        z, more = self.seen[1] if self.seen[0] is rows else self._parts(rows.x, rows.norm)
        with np.errstate(all="ignore"):
            sums = np.einsum("ij,ij->i", y[q, :h], z[r, :h])
            rest = beyond[h][q] * more[h][r] + SLACK * norm[q] * rows.norm[r]
        return sums - rest, sums + rest


def top_k(df: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of the highest scores for each row that ``queries`` picks."""
    n, dims = measure(df, embedding)
    rows = whole(df, dims, vec_id=vec_id, embedding=embedding)
    asks = whole(df.where(queries & F.col(vec_id).isNotNull()), dims, vec_id=vec_id, embedding=embedding)
    sample = sample_of(rows, n, dims)
    bounds = Rotated(matrix(sample["x"].combine_chunks(), dims))
    n_queries = df.where(queries & F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).count()
    got = best(asking(asks), rows, sample, bounds, dims=dims, n=n, n_queries=n_queries, k=k)
    return got.select("query_id", "rank", "vec_id", "score")
