"""Quality rules: hashed n-gram log-likelihood ratio against a trusted target.

Words and word pairs of every text are hashed into ``buckets`` counters, once
for the trusted documents (the target) and once for the whole corpus. A text's
score is the mean over its grams of log p_target / p_corpus. Documents are dealt
to ``FOLDS`` folds by the least hash of their word pairs, and each is scored with
the counts of the other folds only: what a document says itself, and whether it
is trusted, has no part in its own score. Copies lie in one fold, whatever their
ids, and so do near copies unless they differ in just that pair. A document
stays if it passes the base rules and its score reaches ``threshold``.

Column expressions only: no Python on the executors. What is shuffled is
counters, ``FOLDS`` times ``buckets`` of them a task at most, and beyond
``BROADCAST_ROWS`` trusted ids the texts that a bitmap of the ids lets through.
Counters and ratios are tables: the driver sees their totals only, and executors
get the ratios as a broadcast row for each fold. (As a literal they were spelled
out in every description of the plan, which took hundreds of MB of the driver.)

Null text: no words, rejected. Null ids keep their row. Repeated rows are
scored each, alike. With no trusted documents all ratios are 0. A very long
text is scored whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import BROADCAST_ROWS, barrier, bitmap, has_bit, next_to, set_aside, stored

#: Counters, a power of two.
BUCKETS = 65_536
#: Parts of the corpus that are left out in turn.
FOLDS = 4
#: Ratios are whole numbers of thousandths, of 16 bits, which keeps a fold's row small; a score is off by 0.0005 at most.
UNIT = 1_000
#: Longs of the bitmap of trusted ids: 8 MB, for lists that are too long to broadcast.
ID_BITMAP = 1 << 20
#: Counts added to each bucket, dealt to target and corpus in the ratio of their sizes.
SMOOTH = 16.0
#: Nats per gram. A typical clean text scores just above 0, junk well below.
THRESHOLD = -0.13
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def n_among(text: Column, chars: str) -> Column:
    """How many of the characters the text has; most texts have none, which a scan tells cheaply."""
    return F.when(text.rlike(f"[{chars}]"), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def _hashes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_h1`` and ``_h2``: hashes of the words and of the neighbouring pairs."""
    df = barrier(df, _w=words_of(F.col(text)))
    df = barrier(df, _h1=F.transform("_w", lambda w: F.xxhash64(w)))
    return barrier(df, _h2=pairs(F.col("_h1"), 1))


def pairs(h: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), next_to(h, step), lambda a, b: F.xxhash64(a, b))


def bucket_of(h: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(h, 65 - buckets.bit_length()).cast("int")


def fold_of(h1: str, h2: str) -> Column:
    """By the least pair hash, of single words by theirs; texts without words, which have no grams, are in one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(F.array_min(h2), F.array_min(h1))), F.lit(FOLDS)).cast("int")


def _counts(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """``(b, n)``: counters of the folds one after the other."""
    grams = barrier(_hashes(df.select(F.col(text)), text), _fold=fold_of("_h1", "_h2"))
    grams = grams.select("_fold", F.explode(F.concat("_h1", "_h2")).alias("_h"))
    return grams.groupBy((F.col("_fold") * buckets + bucket_of(F.col("_h"), buckets)).alias("b")).agg(F.count("*").alias("n"))


def _among(df: DataFrame, good: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is in ``good``; of the others no text is shuffled but what a bitmap can't tell."""
    if good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(good), "doc_id", "left_semi")
    bits = bitmap(good.select(F.xxhash64("doc_id").alias("h")), ID_BITMAP)
    return df.where(has_bit(F.xxhash64("doc_id"), bits, ID_BITMAP)).join(good.hint("merge"), "doc_id", "left_semi")


def log_ratios(df: DataFrame, good: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """``(_from, _ratios)``: for each fold the log ratio of each bucket in thousandths, by the counts of the other folds; ``FOLDS`` rows of ``buckets`` numbers."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    zero, folds = F.lit(0).cast("bigint"), range(FOLDS)
    raw = _counts(rows, "text", buckets).select("b", F.col("n").alias("raw"), zero.alias("own"))
    own = _counts(_among(rows, good), "text", buckets).select("b", zero.alias("raw"), F.col("n").alias("own"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), zero.alias("raw"), zero.alias("own"))
    fold = F.floor(F.col("b") / buckets)
    sums = [F.sum(F.when(fold == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("raw", "own") for k in folds]
    counters = stored(raw.union(own).union(every).groupBy((F.col("b") % buckets).alias("bucket")).agg(*sums), "counters")
    total = counters.agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in ("raw", "own") for k in folds]).first()

    def ratio(k: int) -> Column:
        n_raw, n_own = (sum(total[f"{c}{i}"] for i in folds if i != k) for c in ("raw", "own"))
        if not n_own:  # without a target nothing is said
            return F.lit(0)
        others = {c: sum((F.col(f"{c}{i}") for i in folds if i != k), zero) for c in ("raw", "own")}
        share = n_own / n_raw
        return F.rint(UNIT * F.ln((others["own"] + SMOOTH * share) / ((others["raw"] + SMOOTH) * share)))

    each = F.array(*[F.struct(F.lit(k).alias("_from"), "bucket", ratio(k).cast("smallint").alias("r")) for k in folds])
    ratios = counters.select(F.inline(each)).groupBy("_from").agg(F.sort_array(F.collect_list(F.struct("bucket", "r"))).alias("all"))
    return stored(ratios.select("_from", F.col("all.r").alias("_ratios")), "ratios")


def with_repeats(df: DataFrame, windows: str, n_window: int) -> DataFrame:
    """Adds ``_repeats``: words covered by windows that occur twice or more, from the windows' hashes in order.

    Sorting the hashes with their places makes equal ones neighbours. Each step
    is computed once, and only for texts in which a hash repeats.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = barrier(df, _order=F.when(repeats, F.sort_array(at)).otherwise(none))
    df = barrier(df, _same=F.zip_with(F.col("_order"), next_to(F.col("_order"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    # A member of a run of equals equals the one after or the one before it.
    before = F.concat(F.array(F.lit(False)), F.col("_same"))
    marked = F.zip_with(F.zip_with("_order", "_same", lambda o, s: F.struct(o["i"].alias("i"), s.alias("s"))), F.slice(before, F.lit(1), F.size("_order")), lambda x, p: F.when(x["s"] | p, x["i"]))
    df = barrier(df, _where=F.sort_array(F.array_compact(marked)))
    covered = F.zip_with("_where", next_to(F.col("_where"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(n_window)), F.lit(n_window)))
    return barrier(df, _repeats=F.aggregate(covered, F.lit(0).cast("bigint"), lambda acc, x: acc + x)).drop("_order", "_same", "_where")


def annotate(df: DataFrame, *, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    ``trusted``: ``(doc_id, quality)``; an id with any quality of 1 is in the
    target. Columns of the names above are replaced, all others are kept, whatever their names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    good = trusted.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ratios = log_ratios(df, good, doc_id, text, buckets)
    rows, back = set_aside(df.select(*[c for c in df.columns if c not in made]), doc_id, text)
    own = rows.columns
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = barrier(rows, _lines=F.when(F.contains(t, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")), n_symbols=n_among(t, "#*$%&|<>").cast("bigint"))
    # What is read off the text comes first: later steps then carry the hashes only.
    rows = barrier(rows, _w=words_of(F.col(text)), n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")
    rows = barrier(rows, _h1=F.transform("_w", lambda w: F.xxhash64(w)), word_chars=F.length(F.array_join("_w", "")).cast("bigint")).drop("_w")
    rows = barrier(rows, _h2=pairs(F.col("_h1"), 1))
    rows = barrier(rows, _from=fold_of("_h1", "_h2")).join(F.broadcast(ratios), "_from").drop("_from")
    total = sum(F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, h: acc + F.get("_ratios", bucket_of(h, buckets))) for h in ("_h1", "_h2"))
    rows = barrier(rows, n_words=F.size("_h1").cast("bigint"), llr=total / (UNIT * F.greatest(F.size("_h1") + F.size("_h2"), F.lit(1))), _h4=pairs(F.col("_h2"), 2)).drop("_h1", "_h2", "_ratios")
    rows = with_repeats(barrier(rows, _h8=pairs(F.col("_h4"), 4)).drop("_h4"), "_h8", WINDOW).withColumnRenamed("_repeats", "n_repeat_words")
    rows = rows.select(*back, *made[:5], "llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))

