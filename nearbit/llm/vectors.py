"""Exact searches with integer inner products, in blocks of queries and streams of rows.

Components become floor(``SCALE`` * x), held as doubles, which are exact there.
A task gets one block of queries, then a stream of rows in Arrow batches, so it
holds a block and a batch, whatever the table's size. What it looks at closely
is chosen by bounds of the scores; every result is an exact integer score.

Each row goes to one group by its hash and is sent once for each block of
queries; each query is sent once for each group. What remains of a group, at
most k rows a query, meets in a window over the query.

Rows of null or non-finite vectors take no part. Shorter vectors are filled up
with zeros, the empty vector too. A row without an id asks nothing, and is found
behind rows of the same score that have one. Of rows that share a query's id the
smallest vector asks and none is found by it; rows that share another id, and
repeated rows, are found each. Scores beyond 64 bits stand at their limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
#: Queries of a block, and rows of a group, about.
QUERIES, ROWS = 32_768, 4_000_000
#: Cells of the sample that models are fitted on and thresholds start from: 4 MB, 8,192 rows of 64 components.
SAMPLE_CELLS = 1 << 19
#: Cells of a matrix of scores that is worked on at a time.
CELLS = 1 << 21
#: Bounds are widened by this share of the product of lengths, far more than what doubles lose.
SLACK = 1e-9
#: Products of lengths below this leave every partial sum of doubles exact.
EXACT = 2.0**52
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

FIELDS = "vec_id long, label long, x array<double>, norm double"


def usable(embedding: str = "embedding") -> Column:
    """Whether the vector has finite components only."""
    finite = lambda e: e.isNotNull() & (F.abs(e.cast("double") * SCALE) < F.lit(float("inf")))
    return F.col(embedding).isNotNull() & F.forall(embedding, finite)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def whole(df: DataFrame, dims: int, *, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | None = None) -> DataFrame:
    """``FIELDS`` of the rows that take part: floored vectors of ``dims`` components, and their lengths."""
    x = F.transform(embedding, lambda e: e.cast("double"))
    filled = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(x)))
    rows = df.where(usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), (F.lit(None) if label is None else label).cast("long").alias("label"), filled.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = np.floor(SCALE * matrix(b.column(2), dims))
            with np.errstate(over="ignore"):
                norm = np.sqrt((ints * ints).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(ints), pa.array(norm)], ["vec_id", "label", "x", "norm"])

    return rows.mapInArrow(run, FIELDS)


def measure(df: DataFrame, embedding: str = "embedding") -> tuple[int, int]:
    """Rows that take part, and components of the longest vector (1 at least)."""
    n, dims = df.where(usable(embedding)).agg(F.count("*"), F.max(F.size(embedding))).first()
    return n, max(1, dims or 1)


@dataclass
class Rows:
    """Rows of a batch, as arrays."""

    ids: np.ndarray
    none: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    codes: np.ndarray | None = None
    residuals: np.ndarray | None = None

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, dims: int) -> Rows:
        get = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        codes = get.get("codes")
        own = codes is not None and len(codes) and codes.null_count == 0
        ids, labels = get["vec_id"], get["label"]
        return cls(
            ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), labels.fill_null(0).to_numpy(), matrix(get["x"], dims), get["norm"].to_numpy(),
            np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1) if own else None,
            matrix(get["residuals"], len(codes[0].as_py())) if own else None,
        )

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, at: slice | np.ndarray) -> Rows:
        return Rows(*(None if v is None else v[at] for v in (self.ids, self.none, self.labels, self.x, self.norm, self.codes, self.residuals)))


class Bounds(Protocol):
    """What is known of scores without the whole inner products."""

    def queries(self, x: np.ndarray) -> object: ...

    def between(self, state: object, q: np.ndarray | slice, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Least and most scores of the queries ``q`` with each row."""
        ...

    def closer(self, state: object, q: np.ndarray, rows: Rows, r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for pairs, at more cost; None if there is nothing closer."""
        ...


def scores(q: np.ndarray, q_norm: np.ndarray, rows: Rows, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    if not len(qi):
        return np.zeros(0, np.int64)
    with np.errstate(all="ignore"):
        if 8 * len(qi) > len(q) * len(rows):
            sums = (q @ rows.x.T)[qi, ri]
        else:
            step = max(1, CELLS // q.shape[1])
            sums = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + step]], rows.x[ri[i : i + step]]) for i in range(0, len(qi), step)])
        exact = q_norm[qi] * rows.norm[ri] < EXACT
    out = np.where(exact, sums, 0).astype(np.int64)
    for p in np.flatnonzero(~exact):
        s = sum(int(a) * int(b) for a, b in zip(q[qi[p]], rows.x[ri[p]], strict=True))
        out[p] = min(max(s, LEAST + 1), MOST)
    return out


@dataclass
class Search:
    """The ``k`` best rows of each window (lows..highs) of each query."""

    bounds: Bounds
    k: int
    #: Which rows count: "other", or those whose label is the "same" or "different".
    rule: str
    asks: Rows
    lows: np.ndarray
    highs: np.ndarray
    least: np.ndarray = field(default=None)
    #: Rows come by descending length, so that what follows cannot reach more.
    falling: bool = True

    def __post_init__(self) -> None:
        self.state = self.bounds.queries(self.asks.x)
        shape = (self.lows.size, self.k)
        self.score, self.ids, self.none = np.full(shape, LEAST), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.found = np.zeros(shape, bool)
        self.wanted = np.maximum(self.lows, LEAST if self.least is None else self.least)

    def look(self, rows: Rows) -> None:
        if not len(self.asks):
            return
        step = max(1, CELLS // len(self.asks))
        for i in range(0, len(rows), step):
            if self._look(rows.part(slice(i, i + step))) and self.falling:
                return

    def _look(self, rows: Rows) -> bool:
        """True if no query can gain from rows of this length."""
        wide = self.asks.norm * rows.norm.max() * (1 + SLACK)
        q = np.flatnonzero(~(wide < self.wanted.min(axis=1)))
        if not len(q):
            return True
        part = slice(None) if len(q) == len(self.asks) else q
        asks = self.asks.part(part)
        lo, hi = self.bounds.between(self.state, part, rows)
        may = (asks.ids[:, None] != rows.ids[None, :]) | rows.none[None, :]
        if self.rule != "other":
            may &= (asks.labels[:, None] == rows.labels[None, :]) == (self.rule == "same")
        qi, ri = np.nonzero(may & self._in_a_window(lo, hi, self.wanted[q], self.highs[q]))
        if len(qi) and (closer := self.bounds.closer(self.state, q[qi], rows, ri)):
            keep = self._in_a_window(*closer, self.wanted[q[qi]], self.highs[q[qi]])
            qi, ri = qi[keep], ri[keep]
        got = scores(asks.x, asks.norm, rows, qi, ri)
        qi = q[qi]
        for j in range(self.lows.shape[1]):
            hit = np.flatnonzero((got >= self.wanted[qi, j]) & (got <= self.highs[qi, j]))
            self._add(qi[hit], j, got[hit], rows.ids[ri[hit]], rows.none[ri[hit]])
        return False

    @staticmethod
    def _in_a_window(lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Whether a score between these may lie in one of the query's windows; a bound that is no number keeps the pair."""
        out = np.zeros(hi.shape, bool)
        for j in range(wanted.shape[-1]):
            w = np.where(wanted[..., j] == LEAST, -np.inf, wanted[..., j])
            h = np.where(highs[..., j] == MOST, np.inf, highs[..., j])
            w, h = (w[:, None], h[:, None]) if hi.ndim > 1 else (w, h)
            out |= ~((hi < w) | (lo > h))
        return out

    def _add(self, q: np.ndarray, j: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(q):
            return
        spot = q * self.lows.shape[1] + j
        who = np.unique(spot)
        where = np.concatenate([np.repeat(who, self.k), spot])
        cols = [np.concatenate([old[who].ravel(), new]) for old, new in ((self.found, np.ones(len(q), bool)), (self.score, score), (self.none, none), (self.ids, ids))]
        order = np.lexsort((cols[3], cols[2], ~cols[1], ~cols[0], where))
        where = where[order]
        rank = np.arange(len(where)) - np.searchsorted(where, where)
        keep = rank < self.k
        for mine, col in zip((self.found, self.score, self.none, self.ids), cols, strict=True):
            mine[where[keep], rank[keep]] = col[order][keep]
        last = np.where(self.found[who, -1], self.score[who, -1], LEAST)
        self.wanted[who // self.lows.shape[1], j] = np.maximum(self.wanted[who // self.lows.shape[1], j], last)

    def result(self) -> pa.RecordBatch:
        at, rank = np.nonzero(self.found)
        width = self.lows.shape[1]
        ids = pa.array(self.ids[at, rank], mask=self.none[at, rank])
        return pa.RecordBatch.from_arrays([pa.array(self.asks.ids[at // width]), pa.array((at % width).astype(np.int32)), ids, pa.array(self.score[at, rank])], ["query_id", "slot", "vec_id", "score"])


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def sample_of(rows: DataFrame, n: int, dims: int) -> pa.Table:
    """A bounded sample by a hash of id and vector, for the driver."""
    most = max(64, SAMPLE_CELLS // dims)
    share = 1.5 * most / max(1, n)
    picked = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The limit only matters if copies of one row make the sample too large.
    return picked.limit(most).toArrow()


def asking(rows: DataFrame, windows: int | None = 1) -> DataFrame:
    """One row for each id, with ``windows`` windows that let every score through (None: the rows have their own)."""
    cols = [c for c in rows.columns if c != "vec_id"]
    one = rows.groupBy("vec_id").agg(F.min(F.struct(*cols)).alias("m")).select("vec_id", *[F.col(f"m.{c}").alias(c) for c in cols])
    if windows is None:
        return one
    return one.withColumns({"lows": F.array_repeat(F.lit(LEAST).cast("long"), windows), "highs": F.array_repeat(F.lit(MOST).cast("long"), windows)})


def best(queries: DataFrame, rows: DataFrame, sample: pa.Table, bounds: Bounds, *, dims: int, n: int, n_queries: int, k: int, rule: str = "other", windows: int = 1) -> DataFrame:
    """``(query_id, slot, vec_id, score, rank)``: of each query's windows the ``k`` best rows, ties to the smaller id.

    ``queries``: ``FIELDS`` and arrays of ``windows`` ``lows`` and ``highs``, from
    :func:`asking`; ``rows``: ``FIELDS`` and what the bounds need.
    """
    shared = queries.sparkSession.sparkContext.broadcast((bounds, sample))

    def searches(batch: pa.RecordBatch | pa.Table, least: np.ndarray | None) -> Search:
        flat = batch.combine_chunks().to_batches()[0] if isinstance(batch, pa.Table) else batch
        return Search(shared.value[0], k, rule, Rows.of(flat, dims), _integers(flat["lows"], windows), _integers(flat["highs"], windows), least)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``least``: what the k-th best of the sample has is beaten or met by the k-th best of all."""
        seen = Rows.of(shared.value[1], dims)
        seen = seen.part(np.argsort(-seen.norm, kind="stable"))
        for b in batches:
            if b.num_rows:
                s = searches(b, None)
                s.look(seen)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * windows, pa.int32()), pa.array(s.wanted.ravel()))], [*b.schema.names, "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        search: Search | None = None
        for b in batches:
            cut = int(np.searchsorted(b["tag"].to_numpy(), 1))  # queries come first
            if cut:
                waiting.append(b.slice(0, cut))
            if cut < b.num_rows and (search or waiting):
                if search is None:
                    asks = pa.Table.from_batches(waiting)
                    search = searches(asks, _integers(asks.combine_chunks()["least"].combine_chunks(), windows))
                search.look(Rows.of(b.slice(cut), dims))
        if search:
            yield search.result()

    fields = f"{FIELDS}, lows array<long>, highs array<long>"
    started = queries.select("vec_id", "label", "x", "norm", "lows", "highs").mapInArrow(start, f"{fields}, least array<long>")
    width = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, ceil(n_queries / QUERIES))
    groups = max(ceil(width / blocks), ceil(n / ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = started.withColumn("tag", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("grp", every(groups))
    dealt = rows.withColumn("tag", F.lit(1)).withColumn("grp", F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    both = asked.unionByName(dealt, allowMissingColumns=True)
    streams = both.repartitionById(blocks * groups, F.col("block") * groups + F.col("grp")).sortWithinPartitions("tag", F.desc("norm"))
    got = streams.drop("block", "grp").mapInArrow(run, "query_id long, slot int, vec_id long, score long")
    order = W.partitionBy("query_id", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
