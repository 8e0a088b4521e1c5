"""MinHash near-duplicates: circulant signatures, bands, exact Jaccard.

1. Every whole text becomes a set of shingle hashes; texts with equal sets form
   a class, which its smallest id represents. Only representatives go on.
2. Circulant MinHash (two permutations, one shifted) makes the signature;
   ``bands`` of ``rows`` coordinates make the buckets. Two texts at the
   threshold miss all buckets with probability 3e-6 at 80 % and 32 bands, as
   is the default, and 8e-6 at 85 % and 20 bands.
3. In each bucket the member with the most company is the pivot; all others are
   compared with it on their full sets. Links make components.
4. Buckets with members outside the pivot's component are tested completely:
   those members against all, in blocks of bounded size, on full sets. A block
   returns links that span its components, so the rows stay linear in the
   members, though no link between different texts is lost.

A row is known by its set, not by its id: repeated rows and ids share their
class. Null and empty texts link with nothing and stay. Rows with a null id take
part under a number of their own, from ``NAMELESS`` on, that comes from the text;
ids have to be below that. So a null id is never the smallest of a group with
ids; in groups without any, the component is null and rows of one text stay.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.llm import shingles as S
from nearbit.llm.common import set_aside, slices, stored
from nearbit.llm.components import components

BANDS, ROWS = 32, 5
SHINGLE_WORDS = 5
PERCENT = 80
#: Numbers of rows without an id.
NAMELESS = 1 << 62
#: Members of a block's side.
BLOCK = 256


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _profiles(n: int, bands: int, rows: int):
    names = ["n_shingles", "d1", "d2", *[f"b{k}" for k in range(bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sketch = S.WordHashes(), S.Circulant(bands * rows)
        for batch in slices(batches):
            out = np.zeros((batch.num_rows, 3 + bands), np.int64)
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = S.shingle_set(text, n, memory)
                if len(found):
                    out[i, 0] = len(found)
                    out[i, 1:3] = np.frombuffer(S.set_digest(found), np.int64)
                    coords = sketch.signature(found).reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                    for r in range(rows):
                        key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + coords[:, r])
                    out[i, 3:] = _signed(key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(out[:, k]) for k in range(out.shape[1])]], ["doc_id", "mark", "node", *names])

    return run, "doc_id long, mark long, node long, " + ", ".join(f"{c} long" for c in names)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = S.WordHashes()
        for batch in slices(batches):
            found = [S.shingle_set(t, n, memory).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rep", "shingles"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            ok = [S.jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def linked_within(sets: list[np.ndarray], percent: int, wide: int = 4096) -> np.ndarray:
    """All pairs at the threshold, as a boolean matrix, by exact intersection sizes."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[at] > 1  # what one text alone has is in no intersection
    column = np.cumsum(many > 1) - 1
    at, owner, n = column[at[shared]], owner[shared], int((many > 1).sum())
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for lo in range(0, n, wide):
        i, j = np.searchsorted(at, (lo, lo + wide))
        has = np.zeros((len(sets), min(wide, n - lo)), np.float32)
        has[owner[i:j], at[i:j] - lo] = 1
        both += has @ has.T
    both = both.astype(np.int64)  # exact: float32 counts to 2^24
    close = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(close, True)
    return close


def _block_links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        ids = np.array(block["rep"].to_pylist(), np.int64)
        ids, first = np.unique(ids, return_index=True)
        raw = block["shingles"].to_pylist()
        close = linked_within([np.frombuffer(raw[i], np.uint64) for i in first], percent)
        left, found = set(range(len(ids))), []
        while left:  # a spanning tree of each component
            todo = [min(left)]
            left.discard(todo[0])
            while todo:
                x = todo.pop()
                for y in [y for y in np.flatnonzero(close[x]).tolist() if y in left]:
                    left.discard(y)
                    todo.append(y)
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _grouped(df: DataFrame, doc_id: str, text: str, n: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """``(doc_id, mark, node, n_shingles, top)`` for every row: a hash of its text, its number and the smallest number of its group."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    node = F.coalesce(F.col(doc_id).cast("long"), mark.bitwiseAND(NAMELESS - 1) + NAMELESS)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), mark.alias("mark"), node.alias("node"), F.col(text).alias("text"))
    run, schema = _profiles(n, bands, rows)
    profile = stored(docs.mapInArrow(run, schema), "profiles")
    full = profile.where("n_shingles > 0")
    keys = [f"b{k}" for k in range(bands)]
    classes = stored(full.groupBy("d1", "d2").agg(F.min("node").alias("rep"), *[F.first(k).alias(k) for k in keys]), "classes")

    banded = classes.select("rep", F.explode(F.array(*keys)).alias("key"))  # the key holds the band
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(crowded.hint("merge"), "key"), "members")
    if members.limit(1).count():
        label = _labels(docs.select("node", "text"), members, n, percent, block)
        named = classes.select("d1", "d2", "rep").join(label.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("top"))
    else:
        named = classes.select("d1", "d2", F.col("rep").alias("top"))
    named = stored(named, "named")
    cols = ["doc_id", "mark", "node", "n_shingles"]
    out = full.join(named.hint("merge"), ["d1", "d2"]).select(*cols, "top")
    return out.union(profile.where("n_shingles = 0").select(*cols, F.col("node").alias("top")))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row."""
    got = _grouped(df, doc_id, text, n, percent, bands, rows, block)
    return got.select("doc_id", "n_shingles", F.when(F.col("top") < NAMELESS, F.col("top")).alias("component_id"), (F.col("node") == F.col("top")).alias("kept"))


def deduplicated(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Of each group of near duplicates one row, with all columns: that with the smallest id; of its copies under the same id any.

    Texts without words stay, all of them.
    """
    got = _grouped(df, doc_id, text, n, percent, bands, rows, block).where("node = top")
    stay = stored(got.groupBy("doc_id", "mark").agg((F.count_if(F.col("n_shingles") > 0) > 1).alias("again")), "stay")
    given, back = set_aside(df, doc_id, text)
    marked = given.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))

    def rows_of(keys: DataFrame) -> DataFrame:
        same = [F.col(f"x.{doc_id}").cast("long").eqNullSafe(F.col("y.doc_id")), F.col("x._mark") == F.col("y.mark")]
        return marked.alias("x").join(keys.alias("y").hint("merge"), same, "left_semi")

    out = rows_of(stay.where("not again")).select(*back)
    if stay.where("again").limit(1).count():  # rows that repeat id and text
        out = out.union(rows_of(stay.where("again")).dropDuplicates([doc_id, "_mark"]).select(*back))
    return out


def _labels(docs: DataFrame, members: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """``(node, label)`` of the representatives that have links."""
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    rated = members.join(company.hint("merge"), "rep")
    pivots = stored(rated.groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("m"), F.first("size").alias("size"), F.sum(F.xxhash64("rep").bitwiseAND(0xFFFFFFFFFFFF)).alias("mark")).select("key", (-F.col("m.minus")).alias("pivot"), "size", "mark"), "pivots")

    needed = members.select(F.col("rep").alias("node")).distinct()
    texts = docs.join(needed.hint("merge"), "node", "left_semi")
    sets = texts.mapInArrow(_sets(n), "rep long, shingles binary")
    sets = stored(sets, "sets")

    star = members.select("key", "rep").join(pivots.select("key", "pivot").hint("merge"), "key").where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first = star.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
    links = stored(first.mapInArrow(_verified(percent), "a long, b long"), "links")
    label = components(links)

    # Buckets of equal members count once; of two members, the star has tested all.
    once = pivots.where("size > 2").groupBy("size", "mark", "pivot").agg(F.min("key").alias("key"))
    placed = members.select("key", "rep").join(once.select("key", "pivot").hint("merge"), "key")
    mine = label.select(F.col("node").alias("rep"), F.col("label").alias("own"))
    pivotal = label.select(F.col("node").alias("pivot"), F.col("label").alias("main"))
    placed = placed.join(mine.hint("merge"), "rep", "left").join(pivotal.hint("merge"), "pivot", "left")
    placed = stored(placed.select("key", "rep", (F.coalesce("own", "rep") == F.coalesce("main", "pivot")).alias("main")), "placed")
    counts = placed.groupBy("key").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest")).where("n_rest > 0 and n_main + n_rest > 2")
    open_ = placed.join(counts.hint("merge"), "key")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    open_ = open_.withColumn("rests", parts("n_rest")).withColumn("mains", parts("n_main"))
    mix = F.xxhash64("rep")
    i = F.when(F.col("main"), F.pmod(mix, F.col("mains"))).otherwise(F.pmod(mix, F.col("rests"))).cast("int")
    small = F.col("n_main") + F.col("n_rest") <= block
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A block is a pair of a part of the rest with a part of the rest (second >= 0) or of the main members (second < 0).
    of_main = F.transform(upto("rests"), lambda r: F.struct(r.alias("x"), (-1 - F.col("i")).alias("y")))
    of_rest = F.concat(
        F.transform(upto("rests"), lambda r: F.struct(F.least(r, F.col("i")).alias("x"), F.greatest(r, F.col("i")).alias("y"))),
        F.when(F.col("mains") > 0, F.transform(upto("mains"), lambda m: F.struct(F.col("i").alias("x"), (-1 - m).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>")),
    )
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = open_.withColumn("i", i).withColumn("to", F.explode(F.when(small, whole).when(F.col("main"), of_main).otherwise(of_rest))).select("key", "rep", "to.x", "to.y")
    blocks = dealt.join(sets.hint("merge"), "rep").groupBy("key", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
    more = stored(blocks, "more")
    if not more.limit(1).count():
        return label
    # Contract what the first round joined, then join what is left.
    names = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = more.join(names.hint("merge"), "a", "left").join(other.hint("merge"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    between = stored(between, "between")
    if not between.limit(1).count():
        return label
    higher = components(between)
    known = label.join(higher.select(F.col("node").alias("label"), F.col("label").alias("top")).hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = higher.join(label.hint("merge"), "node", "left_anti").select("node", "label")
    return known.union(alone)
