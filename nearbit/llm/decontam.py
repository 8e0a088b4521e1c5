"""Benchmark decontamination by winnowing.

A text's grams of ``k`` words are hashed; in every run of ``window - k + 1``
neighbouring grams the least hash is kept. Two texts that share ``window``
words in a row share such a run, so they share a kept hash: comparing kept
hashes finds every shared window. Around each hit the window is extended on the
words themselves, so what is reported is exact.

Items of fewer than ``window`` words are one window each. Those of ``k`` or
more words hold a gram in full but no whole run, so for each such length that
occurs, documents are winnowed with a shorter run (length - k + 1); shorter
items are looked up by all their words. Both stay empty for most benchmarks.

Column expressions only. A bitmap of the benchmark's hashes, a literal of
bounded size, drops other grams before anything is exploded; the join on the
hash decides. Nothing but hits and their few words of context is shuffled.

Null texts have no words. Null item ids are left out of items; rows of the same
item id count as one item with all their windows. Hits are kept by id and text,
nulls alike, so rows that share an id are told apart and rows without one are
judged too; repeated rows get the same answer each. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearbit.llm.common import barrier, bitmap, has_bit, next_to, set_aside, small_side, stored
from nearbit.llm.quality import pairs

WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII, in ASCII lower case."""
    t = F.coalesce(text, F.lit(""))
    # For plain ASCII the faster function gives the same.
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(low, "[\\x00-/:-`{-\\x7F]+"), lambda w: w != "")


def least_of(h: Column, n: int) -> list[Column]:
    """How to get sliding minima of ``n`` neighbours: the steps to double by."""
    steps, span = [], 1
    while span < n:
        step = min(span, n - span)
        steps.append(step)
        span += step
    return steps


def _least_with(h: Column, step: int) -> Column:
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), next_to(h, step), lambda a, b: F.least(a, b))


def _grams(df: DataFrame, k: int, words: str = "_words") -> DataFrame:
    """Adds ``_grams``: the hash of each run of ``k`` words."""
    df = barrier(df, _g1=F.transform(words, lambda w: F.xxhash64(w)))
    span, last = 1, "_g1"
    while span < k:
        step = min(span, k - span)
        name = f"_g{span + step}"
        df = barrier(df, **{name: pairs(F.col(last), step)})
        span, last = span + step, name
    return df.withColumnRenamed(last, "_grams").drop(*[f"_g{i}" for i in range(1, k)])


def _kept(df: DataFrame, run: int) -> DataFrame:
    """Adds ``_kept``: the hash that each run of grams keeps; a text with fewer grams, but any, keeps its least."""
    short = (F.size("_grams") > 0) & (F.size("_grams") < run)
    df, last, made = barrier(df, _m0=F.col("_grams")), "_m0", ["_m0"]
    for step in least_of(F.col("_grams"), run):
        made.append(f"_m{len(made)}")
        df = barrier(df, **{made[-1]: _least_with(F.col(last), step)})
        last = made[-1]
    return df.withColumn("_kept", F.when(short, F.array(F.array_min("_grams"))).otherwise(F.col(last))).drop(*made)


def _spot(documents: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """``(doc, mark, at, span, items)`` for each place where one of the windows of ``window`` words occurs.

    ``windows``: ``(words, items)``, distinct by words. The place is the index
    of the window's first word.
    """
    run = window - k + 1
    prints = _kept(_grams(windows.withColumnRenamed("words", "_words"), k), run)
    prints = prints.select(F.explode(F.array_distinct("_kept")).alias("h")).distinct()
    bits = bitmap(prints)
    doc = _kept(_grams(documents, k), run)
    # Kept hashes come in runs of equals: the first of each run is enough to know that the text is concerned.
    doc = doc.where(F.exists("_kept", lambda h: has_bit(h, bits)))
    n = F.size("_words")
    doc = barrier(doc, _fp=F.filter(F.array_distinct("_kept"), lambda h: has_bit(h, bits)))
    near = F.filter(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda g: F.array_contains(F.col("_fp"), g["h"]))
    doc = doc.withColumn("_g", F.explode(near))
    start = F.greatest(F.col("_g.i") - (window - k), F.lit(0))
    context = F.slice("_words", start + 1, F.lit(2 * window - k))
    hits = doc.select("doc", "mark", F.col("_g.h").alias("h"), start.alias("start"), context.alias("context"))
    hits = hits.join(small_side(prints), "h", "left_semi")
    spots = F.transform(F.sequence(F.lit(0), F.size("context") - window), lambda o: F.struct((F.col("start") + o).alias("at"), F.slice(F.col("context"), o + 1, window).alias("words")))
    spots = hits.where(F.size("context") >= window).select("doc", "mark", F.explode(spots).alias("s")).select("doc", "mark", "s.at", "s.words")
    return spots.join(small_side(windows), "words").select("doc", "mark", "at", F.lit(window).alias("span"), "items")


def marked(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc, mark, _words)``: the id, a hash of the text that tells rows of one id apart, and the words."""
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("_text")).withColumn("mark", mark_of(F.col("_text")))
    return barrier(rows, _words=words_of(F.col("_text"))).drop("_text")


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(x: str, y: str, doc_id: str = "doc") -> list[Column]:
    """The condition that rows of two frames, named ``x`` and ``y``, have the same id, null or not, and text."""
    return [F.col(f"{x}.{doc_id}").eqNullSafe(F.col(f"{y}.doc")), F.col(f"{x}.mark") == F.col(f"{y}.mark")]


def hits(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``(doc, mark, at, span, items)``: every occurrence of an item window in the document of that id and text."""
    return _hits_of(marked(documents, doc_id, text), benchmark, item_id, item_text, window, k)


def _hits_of(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, k: int) -> DataFrame:
    items = barrier(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("_text")), words=words_of(F.col("_text"))).where("size(words) > 0").drop("_text")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))), lambda o: F.slice("words", o + 1, window))
    windows = items.select("item", F.explode(starts).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = windows.withColumn("n", F.size("words"))
    found = None
    for row in windows.groupBy("n").count().collect():  # at most ``window`` rows
        own = windows.where(F.col("n") == row["n"]).drop("n")
        got = _spot(docs, own, row["n"], min(k, row["n"]))
        found = got if found is None else found.union(got)
    if found is None:
        return docs.select("doc", "mark", F.lit(0).alias("at"), F.lit(0).alias("span"), F.array().cast("array<string>").alias("items")).where("false")
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Every document with ``(doc_id, n_words, n_hit, n_items, items, spans, contaminated)``.

    ``spans``: the hit word ranges, merged, as structs (start, end).
    """
    docs = marked(documents, doc_id, text)
    found = stored(_hits_of(docs, benchmark, item_id, item_text, window, k), "hits")  # read twice; hits only
    by_doc = found.groupBy("doc", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Places in order, each with the furthest end so far: where the next begins behind it, a range ends.
    near = W.partitionBy("doc", "mark").orderBy("at", "end")
    places = found.select("doc", "mark", "at", (F.col("at") + F.col("span")).alias("end")).distinct()
    places = places.withColumn("far", F.max("end").over(near.rowsBetween(W.unboundedPreceding, -1)))
    places = places.withColumn("range", F.sum(F.when(F.col("at") <= F.col("far"), 0).otherwise(1)).over(near.rowsBetween(W.unboundedPreceding, 0)))
    ranges = places.groupBy("doc", "mark", "range").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    spans = ranges.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    by_doc = by_doc.alias("x").join(spans.alias("y").hint("merge"), same_row("x", "y")).select("x.*", "spans", "n_hit")
    counted = docs.select("doc", "mark", F.size("_words").cast("bigint").alias("n_words"))
    out = counted.alias("x").join(by_doc.alias("y").hint("merge"), same_row("x", "y"), "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("bigint")
    out = out.select(F.col("x.doc").alias("doc_id"), "x.mark", "n_words", n_hit.alias("n_hit"), items.alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"), F.col("mark").alias("text_hash"))


def clean(documents: DataFrame, benchmark: DataFrame, *, most_hit: float = 0, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows, with all columns, of which at most ``most_hit`` percent of the words are hit."""
    found = decontaminate(documents, benchmark, doc_id=doc_id, text=text, **options)
    hit = found.where(100 * F.col("n_hit") > most_hit * F.col("n_words")).select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("mark")).distinct()
    rows, back = set_aside(documents, doc_id, text)
    rows = rows.withColumn("mark", mark_of(F.col(text)))
    return rows.alias("x").join(hit.alias("y").hint("merge"), same_row("x", "y", doc_id), "left_anti").select(*back)
