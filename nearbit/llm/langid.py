"""Language by nearest centroid.

A text is a normalised TF-IDF vector of hashed n-grams of 1 to 4 bytes of its
letters. Training texts of each language are clustered on the sphere, which
gives several centroids a language; a text gets the language of the centroid
with the largest cosine. Texts that are farther from all centroids than nearly
all training texts of that language are from their own are ``rejected``; they
keep the nearest language, since the prediction is always a learned value.

Training reads whole texts, at most ``GROUPS`` * ``PER_GROUP`` of each language,
from the training folds: of each of ``GROUPS`` groups of hashes those with the
least. Texts become vectors where they lie, and each language is clustered by
one task, so the driver holds the model only: ``CENTROIDS`` * ``DIMS`` floats
(128 KB) a language, whatever the languages' number. Repeated rows train once;
of rows that share an id and a language, one trains.

Null texts and texts without a letter are ``und``, with score 0; so is every
text if nothing could be learned. Of languages at the same distance the first
in order wins. Rows with a null id are held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearbit.llm.common import held_out, slices, small_side, stored

UNKNOWN = "und"
DIMS = 1 << 13
GROUPS, PER_GROUP, CENTROIDS, ROUNDS = 32, 20, 4, 12
#: Share of a language's training texts that are nearer than its limit.
NEAR = 0.995
ASCII_LETTERS, LETTERS = re.compile(r"[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vector(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None without a letter."""
    low = text.lower() if text else ""
    joined = " ".join((ASCII_LETTERS if low.isascii() else LETTERS).findall(low))
    if not joined:
        return None
    b = np.frombuffer(f" {joined} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    code = np.zeros(0, np.uint32)
    for n in range(1, 5):
        code = b.copy() if n == 1 else code[:-1] * np.uint32(257) + b[n - 1 :]
        if not len(code):
            break
        counts += np.bincount((code * np.uint32(2_654_435_761) + np.uint32(n)) >> np.uint32(19), minlength=DIMS)
    return counts


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as vectors of length 1."""
    x = np.log1p(counts, dtype=np.float32)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, far = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        found = [(i, v) for i, t in enumerate(texts) if (v := vector(t)) is not None]
        if found and len(self.centroids):
            near = unit(np.stack([v for _, v in found]), self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            for (i, _), c, row in zip(found, best, near, strict=True):
                lang[i], score[i] = self.languages[self.owner[c]], float(min(1.0, max(0.0, row[c])))
                far[i] = bool(row[c] < self.limit[self.owner[c]])
        return lang, score, far


def clusters(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def training_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, text)`` of the rows that train."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    h = F.xxhash64("doc_id", F.lit("langid"))
    # Tasks send their own least of each group only; a group is a 32nd of a language.
    group = W.partitionBy("lang", F.pmod("h", F.lit(GROUPS))).orderBy("h", "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("h", h).withColumn("r", F.row_number().over(group)).where(F.col("r") <= PER_GROUP).select("lang", "doc_id")
    once = rows.join(small_side(stored(ids, "training-ids")), ["lang", "doc_id"], "left_semi")
    return once.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = [(lang, v) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := vector(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for _, v in got], pa.binary())], ["lang", "counts"])


def _counts(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column, in an order that doesn't depend on the tasks."""
    raw = sorted(column.to_pylist())
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), DIMS)


def _seen_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, texts with it); dimension -1 counts the texts."""
    seen = np.zeros(DIMS + 1, np.int64)
    for batch in slices(batches):
        x = _counts(batch.column(1))
        seen[:DIMS] += (x > 0).sum(axis=0)
        seen[DIMS] += len(x)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == DIMS, -1, at)), pa.array(seen[at])], ["dim", "n"])


def fit(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", centroids: int = CENTROIDS) -> Model:
    rows = stored(training_rows(documents, doc_id, text, lang).mapInArrow(_vectors, "lang string, counts binary"), "vectors")
    seen = np.zeros(DIMS + 1, np.int64)
    for r in rows.mapInArrow(_seen_in, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # at most DIMS + 1
        seen[r["dim"]] = r["n"]
    if not seen[DIMS]:
        return Model()
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1

    def cluster(group: pa.Table) -> pa.Table:
        x = unit(_counts(group["counts"]), idf)
        centres = clusters(x, centroids)
        limit = float(np.quantile((x @ centres.T).max(axis=1), 1 - NEAR))
        return pa.table({"lang": [group["lang"][0].as_py()], "centroids": [centres.astype("<f4").tobytes()], "limit": [limit]})

    got = sorted(rows.groupBy("lang").applyInArrow(cluster, "lang string, centroids binary, limit double").collect())
    made = [np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMS) for r in got]
    owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
    return Model([r["lang"] for r in got], idf, np.concatenate(made), owner, np.array([r["limit"] for r in got]))


def identify(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, doc_id=doc_id, text=text, lang=lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, score, far = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
