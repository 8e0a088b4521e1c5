"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (positives) and texts whose kind is kept
from it (unlabelled), never confirmed clean ones. With class prior pi, the risk is
pi R_p(+) + max(0, R_u(-) - pi R_p(-)): what the positives hidden among the
unlabelled add to their risk is taken off again, and where a step would take
off more than there is, it goes the other way. ``MODELS`` linear models
on different parts of the training rows are averaged.

Training reads labelled rows of the training folds only: about ``POSITIVES`` of
the toxic ones and about ``UNLABELLED`` of all, without their labels, by a hash
of the id, so that the same rows train at any partitioning. Both come from one
population, so the share of toxic labels in it is the prior. Texts stay on the
executors: they count in how many positives and unlabelled texts each hashed
feature occurs, then send what the ``FEATURES`` chosen ones count in each text.
The driver holds at most ``DIMS`` counts and those rows.

Scores use nothing but the text, all of it. Null and empty texts score like a
text without known words. Rows with a null id are held out. Repeated rows score
alike; labels that disagree count as toxic. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import held_out, slices
from nearbit.llm.text_model import DIMS, WordFeatures

POSITIVES, UNLABELLED = 4_000, 12_000
MODELS, STEPS, RATE, DECAY = 2, 300, 0.1, 1e-4
#: Features that are learned; positives that each must be seen in; standard errors by which it must be commoner there.
FEATURES, LEAST, SURE = 4_096, 2, 1.5
THRESHOLD = 0.3
#: Without any toxic label, every text gets this score.
NOTHING_LEARNED = 0.0


@dataclass
class Model:
    """``places``: a feature's place among ``weights``, or -1."""

    places: np.ndarray = field(default_factory=lambda: np.full(DIMS, -1, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def chosen(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, most: int = FEATURES) -> np.ndarray:
    """The features that are surest to be commoner among the positives, by the lower bound of the log ratio of their shares."""
    a, b = in_p.astype(float), in_u + 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(a / n_p) - np.log(b / (n_u + 1))
        error = np.sqrt(np.maximum(0, 1 / a - 1 / n_p) + 1 / b)
    bound = np.where(in_p >= LEAST, ratio - SURE * error, -np.inf)
    order = np.lexsort((np.arange(len(bound)), -bound))[:most]
    return np.sort(order[bound[order] > 0])


def train(rows: list[tuple[bool, bool, np.ndarray, np.ndarray]], size: int, prior: float, *, models: int = MODELS, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss; each model leaves out another part of the rows.

    ``rows``: (is a positive, is unlabelled, features, counts); a row may be both.
    """
    is_p, is_u = (np.array([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    col = np.concatenate([r[2] for r in rows]).astype(np.int64)
    val = np.log1p(np.concatenate([r[3] for r in rows]))
    weights, biases = [], []
    for k in range(models):
        used = np.random.default_rng(seed + k).random(len(rows)) < 0.8 if models > 1 else np.ones(len(rows), bool)
        p, u = used & is_p, used & is_u
        if not p.any() or not u.any():
            p, u = is_p, is_u
        n_p, n_u = p.sum(), u.sum()
        w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * val, len(rows)) + b, -30, 30)))
            minus = -np.log(np.maximum(1 - s, 1e-12))
            if minus[u].mean() - prior * minus[p].mean() >= 0:
                grad = u * s / n_u - p * prior / n_p  # of the two terms of the positives, s cancels out
            else:  # more is taken off than there is
                grad = p * prior * s / n_p - u * s / n_u
            g, gb = np.bincount(col, grad[row] * val, size) + DECAY * w, grad.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            one, two = 1 - 0.9**t, 1 - 0.99**t
            w -= RATE * (m / one) / (np.sqrt(v / two) + 1e-8)
            b -= RATE * (mb / one) / (np.sqrt(vb / two) + 1e-8)
        weights.append(w)
        biases.append(b)
    return np.mean(weights, axis=0), float(np.mean(biases))


def training_rows(documents: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, float]:
    """``(p, u, text)`` of the rows that train, and the class prior.

    The ids are broadcast: there are about ``POSITIVES`` + ``UNLABELLED`` at most.
    """
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = seen.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.col("toxic") == 1), F.lit(0)).alias("toxic")).first()
    at = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    p = (F.col("toxic") == 1) & (at < POSITIVES / max(1, total["toxic"]))
    ids = seen.select("doc_id", p.alias("p"), (at < UNLABELLED / max(1, total["n"])).alias("u")).where("p or u")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.join(F.broadcast(ids), "doc_id").select("p", "u", "text"), min(max(total["toxic"] / max(1, total["n"]), 0.005), 0.5)


def _seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, positives with it, unlabelled texts with it) of a task's rows; feature -1 counts the rows."""
    features, seen = WordFeatures(), np.zeros((2, DIMS + 1), np.int64)
    for batch in slices(batches):
        for p, u, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = features.counts(text)[0]
            for k, yes in enumerate((p, u)):
                if yes:
                    seen[k, found] += 1
                    seen[k, DIMS] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == DIMS, -1, at)), pa.array(seen[0, at]), pa.array(seen[1, at])], ["feature", "in_p", "in_u"])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """The model, or None if there is nothing to learn from."""
    rows, prior = training_rows(documents, labels, doc_id, text)
    counted = rows.mapInArrow(_seen_in, "feature long, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("p"), F.sum("in_u").alias("u"))
    seen = np.zeros((2, DIMS + 1), np.int64)
    for r in counted.where(F.col("p") > 0).collect():  # at most DIMS + 1; at -1, in the last place, the rows
        seen[:, r["feature"]] = r["p"], r["u"]
    n_p, n_u = seen[:, DIMS].tolist()
    picked = chosen(seen[0, :DIMS], seen[1, :DIMS], n_p, n_u) if n_p and n_u else np.zeros(0, np.int64)
    if not len(picked):
        return None
    model = Model()
    model.places[picked] = np.arange(len(picked))
    shared = documents.sparkSession.sparkContext.broadcast(model.places)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures(shared.value)
        for batch in slices(batches):
            got = [features.counts(t) for t in batch.column(2).to_pylist()]
            data = [pa.array([x[k].astype(np.int32).tobytes() for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *data], ["p", "u", "f", "n"])

    # Sorted, so that sums of floats come out the same whatever task was first.
    got = sorted(((r["f"], r["n"], r["p"], r["u"]) for r in rows.mapInArrow(read, "p boolean, u boolean, f binary, n binary").collect()))
    model.weights, model.bias = train([(p, u, np.frombuffer(f, np.int32), np.frombuffer(n, np.int32)) for f, n, p, u in got], len(picked), prior)
    return model


def toxicity(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    model = fit(documents, labels, doc_id, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = WordFeatures(model.places) if model else None

        def score(text: str | None) -> float:
            found, n = features.counts(text)
            return model.weights[found] @ np.log1p(n) + model.bias

        for batch in slices(batches):
            z = np.array([score(t) for t in batch.column(2).to_pylist()] if model else [])
            got = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model else np.full(batch.num_rows, NOTHING_LEARNED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
