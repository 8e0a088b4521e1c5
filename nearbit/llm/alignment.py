"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both cut a text wherever white space follows something else, and wherever two
characters meet that no token of either holds side by side. What lies between (a
segment) has the same tokens and links in every text. The relational work is
done once for each distinct segment of the corpus, and a document adds up its
segments:

1. tasks number the distinct segments of their own part of the documents and
   write the documents as these numbers (``coded``);
2. distinct segments are encoded by both libraries; tokens are exploded with
   their positions, a window sums their lengths to ends, a full join on segment
   and end merges both sides, and a running count of common ends, the cuts, is
   the group. Between neighbouring ends lies exactly one token of either side:
   each merged row is one link, without a pair of tokens looked at in vain;
3. each part of the documents meets its segments' links again (a part's rows
   are dealt by the part's number, segments first) and counts for each pair of
   ids the documents that hold it; the sums join the links;
4. each part meets its segments' figures, and every document adds them up.

A null or empty text has no tokens, nor has one that either library doesn't give
back byte for byte; such a document has zeros and counts for no pair. Rows
without an id, repeated rows and rows that share an id are documents each. Empty
tables give no rows. A task holds one part's distinct segments, at most
``SEGMENTS`` at a time, and a batch of documents; texts are read whole, however
long.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearbit.llm.common import release, slices, stored
from nearbit.llm.packing import BYTE_LETTERS, tokenizer_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct segments that a task numbers before it starts anew, and words whose segments it remembers meanwhile.
SEGMENTS, WORDS = 1_000_000, 100_000
#: Segments that are encoded at a time.
BATCH = 4_096
#: A pair of ids is one number: the first's times this, plus the second's.
IDS = 1 << 20

MARK = "▁"
#: Starts with a space or a line break behind something else; other white space starts none.
WORD = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")


def words(text: str | None) -> list[str]:
    """The text, with a space before it, in parts that both libraries encode independently."""
    return WORD.findall(" " + text) if text else []


class Cuts(dict):
    """(character, next character) -> whether both libraries always cut between them.

    No merge crosses what no token holds side by side. Apostrophes are left out:
    what the first library splits there depends on what stands before.
    """

    def __init__(self, tokens: list[bytes], pieces: list[str]) -> None:
        super().__init__()
        self.bytes = {x[i : i + 2] for x in tokens for i in range(len(x) - 1)}
        self.letters = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def __missing__(self, pair: tuple[str, str]) -> bool:
        x, y = pair
        plain = not (x.isspace() or y.isspace() or "'" in pair)
        self[pair] = found = plain and x + y not in self.letters and (x.encode()[-1:] + y.encode()[:1]) not in self.bytes
        return found

    def segments(self, word: str) -> list[str]:
        out, lo = [], 0
        for i, pair in enumerate(zip(word, word[1:], strict=False), 1):
            if self[pair]:
                out.append(word[lo:i])
                lo = i
        out.append(word[lo:])
        return out


class Both:
    """Ids of segments by both libraries, and the bytes of the ids."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        byte_of = {chr(n): b for b, n in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        vocabulary = {i: p for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [bytes(byte_of.get(c, 0) for c in p) if (p := vocabulary.get(i, "")) not in special else b"" for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if wrong := [p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p]:
            raise ValueError(f"piece {wrong[0]!r} crosses segments")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        self.cuts = Cuts(self.a_bytes, [p for i, p in enumerate(pieces) if not self.b.is_byte(i)])

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        first = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        # The library puts one space before what it gets, but gives nothing for nothing; behind a line break it puts none.
        second = self.b.encode([p[1:] if p[0] == " " else p if p[0] == "\n" else "\n" + p for p in parts], num_threads=1)
        for k, p in enumerate(parts):
            if p[0] != " ":
                second[k] = second[k][1 if p[0] == "\n" else 2 :]
            elif p == " ":
                second[k] = [self.mark]
        return first, second


@lru_cache(1)
def worker_tokens(first: str, second: str) -> Both:
    """One for all tasks that a worker runs."""
    return Both(first, second)


def packed(numbers: list[int]) -> bytes:
    """Numbers as four planes of bytes, of which the upper ones compress well."""
    return zlib.compress(np.array(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


CODED = "part int, sub int, code int, segment string, doc_id long, codes binary"


def coded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Of every part: its distinct segments with their numbers (``code``), and its documents as numbers (``codes``)."""
    names = [f.split()[0] for f in CODED.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

    def record(n: int, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sub = TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        in_words: dict[str, list[int]] = {}
        cuts = worker_tokens(tokenizer_path(first), tokenizer_path(second)).cuts

        def codes_of(text: str | None) -> bytes:
            out: list[int] = []
            for w in words(text):
                got = in_words.get(w)
                if got is None:
                    got = in_words[w] = [known.setdefault(s, len(known)) for s in cuts.segments(w)]
                out += got
            return packed(out)

        def dictionary() -> Iterator[pa.RecordBatch]:
            every = list(known)
            for i in range(0, len(every), BATCH):
                some = every[i : i + BATCH]
                n = len(some)
                yield record(n, part=pa.repeat(pa.scalar(part, pa.int32()), n), sub=pa.repeat(pa.scalar(sub, pa.int32()), n), code=pa.array(range(i, i + n), pa.int32()), segment=pa.array(some, pa.string()))

        for batch in slices(batches):
            if len(in_words) > WORDS:
                in_words.clear()
            if len(known) > SEGMENTS:
                yield from dictionary()
                known.clear()
                in_words.clear()
                sub += 1
            codes = [codes_of(t) for t in batch.column(1).to_pylist()]
            n = batch.num_rows
            yield record(n, part=pa.repeat(pa.scalar(part, pa.int32()), n), sub=pa.repeat(pa.scalar(sub, pa.int32()), n), doc_id=batch.column(0), codes=pa.array(codes, pa.binary()))
        yield from dictionary()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, CODED)


def _with_lengths(ids: list[list[int]], table: list[bytes], lengths: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids, their byte lengths, the ids of each segment, and which segments they give back."""
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, many.sum())
    size = lengths[flat]
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(many)
    same = total[ends] - total[ends - many] == np.fromiter(map(len, raw), np.int64, len(raw))
    if b"".join(map(table.__getitem__, flat.tolist())) != b"".join(raw):
        same &= np.fromiter((b"".join([table[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)), bool, len(raw))
    return flat, size, many, same


def encoded(distinct: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``(id, segment, a, a_len, b, b_len)``: ids and byte lengths of both; none where bytes differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_tokens(tokenizer_path(first), tokenizer_path(second))
        tables = [(t, np.fromiter(map(len, t), np.int32, len(t))) for t in (both.a_bytes, both.b_bytes)]
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches, BATCH):
            parts = batch.column(0).to_pylist()
            raw = [p.encode() for p in parts]
            sides = [_with_lengths(ids, *t, raw) for ids, t in zip(both.encode(parts), tables, strict=True)]
            same = sides[0][3] & sides[1][3]
            cols = []
            for flat, size, many, _ in sides:
                keep = np.repeat(same, many)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(same, many, 0))]), pa.int32())
                cols += [pa.ListArray.from_arrays(offsets, pa.array(x[keep], pa.int32())) for x in (flat, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(parts)), pa.int64()), batch.column(0), *cols], ["id", "segment", "a", "a_len", "b", "b_len"])
            at += len(parts)

    return distinct.mapInArrow(run, "id long, segment string, a array<int>, a_len array<int>, b array<int>, b_len array<int>")


@contextmanager
def dealt_by_part_of_keys(spark: SparkSession):
    """While a plan is run: rows that are dealt by a join's first key need no further exchange for the others."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tokens(segs: DataFrame, side: str, partitions: int) -> DataFrame:
    """A row for each token: ``(id, end, <side>)``."""
    dealt = segs.select("id", F.arrays_zip(F.col(side).alias("tok"), F.col(f"{side}_len").alias("len")).alias("t")).repartition(partitions, "id")
    rows = dealt.select("id", F.posexplode("t").alias("pos", "t")).select("id", "pos", "t.tok", "t.len")
    ends = F.sum("len").over(W.partitionBy("id").orderBy("pos"))
    return rows.select("id", ends.alias("end"), F.col("tok").alias(side))


def aligned(segs: DataFrame, partitions: int) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, links)`` of every segment with tokens.

    ``groups``: "a1,a2|b1;a3|b2,b3"; ``links``: numbers of id pairs, as often as they occur.
    """
    merged = tokens(segs, "a", partitions).join(tokens(segs, "b", partitions).hint("merge"), ["id", "end"], "full")
    # From the end backwards a running count of cuts is the group, counted from the last; the nearest token that ends here or later covers the stretch.
    back = W.partitionBy("id").orderBy(F.desc("end")).rowsBetween(W.unboundedPreceding, W.currentRow)
    covering = lambda side: F.last(side, ignorenulls=True).over(back)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    link = covering("a").cast("long") * IDS + covering("b")
    rows = merged.select("id", "end", "a", "b", F.sum(cut).over(back).alias("g"), link.alias("link"))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda t: t[side])
    groups = rows.groupBy("id", "g").agg(listed("a").alias("a"), listed("b").alias("b"), F.collect_list("link").alias("links"))
    said = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("g")).alias("at"), said.alias("said")))), lambda t: t["said"])
    size = lambda c: F.sum(F.size(c)).cast("long")
    return groups.groupBy("id").agg(size("a").alias("n_a"), size("b").alias("n_b"), F.count("*").alias("n_groups"), size("links").alias("n_links"), F.array_join(in_order, ";").alias("groups"), F.flatten(F.collect_list("links")).alias("links"))


def parts_with(codes: DataFrame, figures: DataFrame, n_parts: int) -> DataFrame:
    """Every part's segments with their figures, in the order of their numbers, then its documents; a part is one partition."""
    docs = codes.where("codes IS NOT NULL").select("part", "sub", F.lit(1).alias("tag"), "doc_id", "codes")
    both = figures.withColumn("tag", F.lit(0)).unionByName(docs, allowMissingColumns=True)
    return both.repartitionById(n_parts, F.col("part")).sortWithinPartitions("sub", "tag", "code").drop("part", "id")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """The rows by ``sub`` and ``tag``: (a new sub begins, these are documents, rows)."""
    last = None
    for batch in batches:
        sub, tag = batch["sub"].to_numpy(), batch["tag"].to_numpy()
        edges = np.flatnonzero(np.diff(sub) | np.diff(tag)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if hi > lo:
                yield sub[lo] != last, bool(tag[lo]), batch.slice(lo, hi - lo)
                last = sub[lo]


def pair_counts(parts: DataFrame) -> DataFrame:
    """``(link, n)``: how many documents hold the pair, summed over parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        known = None

        def result() -> Iterator[pa.RecordBatch]:
            if known is not None:
                pairs, n = known[0], known[4]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[n > 0]), pa.array(n[n > 0])], ["link", "n"])

        for new, documents, rows in runs(batches):
            if new:
                yield from result()
                held, known = [], None
            if not documents:
                held.append(rows["links"])
                continue
            if known is None:
                links = pa.chunked_array(held, pa.list_(pa.int64())).combine_chunks() if held else pa.array([], pa.list_(pa.int64()))
                sizes = np.asarray(links.value_lengths().fill_null(0))
                pairs, spot = np.unique(links.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
                known = pairs, spot, sizes, np.cumsum(sizes) - sizes, np.zeros(len(pairs), np.int64)
            _, spot, sizes, start, n = known
            for raw in rows["codes"].to_pylist():
                own = np.unique(numbers(raw))
                if len(own) and (sizes[own] > 0).all():
                    many = sizes[own]
                    at = np.arange(many.sum()) + np.repeat(start[own] - (np.cumsum(many) - many), many)
                    n[np.unique(spot[at])] += 1
        yield from result()

    return parts.mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def summed(parts: DataFrame, *, with_groups: bool = False) -> DataFrame:
    """Every document's figures, and the digest (or the text) of its groups."""
    last = "groups" if with_groups else "groups_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        known = None
        for new, documents, rows in runs(batches):
            if new:
                held, known = [], None
            if not documents:
                held.append(rows.select([*FIGURES, "groups"]))
                continue
            if known is None:
                t = pa.Table.from_batches(held).combine_chunks() if held else None
                figures = np.stack([t[c].combine_chunks().fill_null(0).to_numpy() for c in FIGURES], axis=1) if t else np.zeros((0, len(FIGURES)), np.int64)
                known = figures, t["groups"].to_pylist() if t else []
            figures, said = known
            out, text = np.zeros((rows.num_rows, len(FIGURES)), np.int64), []
            for i, raw in enumerate(rows["codes"].to_pylist()):
                own = numbers(raw)
                mine = figures[own]
                if len(own) and (mine[:, 0] > 0).all():
                    out[i] = mine.sum(axis=0)
                    joined = ";".join([said[c] for c in own.tolist()])
                    text.append(joined if with_groups else hashlib.sha256(joined.encode()).hexdigest())
                else:
                    text.append("")
            yield pa.RecordBatch.from_arrays([rows["doc_id"], *(pa.array(c) for c in out.T), pa.array(text, pa.string())], ["doc_id", *FIGURES, last])

    return parts.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in FIGURES)}, {last} string")


def align(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, with_groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    ``n_best``: links whose count is their first id's highest; ``count_sum``: the
    links' counts, a pair's count being the documents that hold it linked.
    ``with_groups`` gives the groups themselves instead of their digest.
    """
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    codes = stored(coded(df, doc_id, text, first, second), "coded-texts", "zstd")
    n_parts = (codes.agg(F.max("part")).first()[0] or 0) + 1
    own = codes.where("segment IS NOT NULL").select("part", "sub", "code", "segment")
    segs = stored(encoded(own.select("segment").distinct(), first, second), "segments", "zstd")
    release()
    own = stored(own.join(segs.select("segment", "id").hint("merge"), "segment").drop("segment"), "part-segments", "zstd")
    release()
    with dealt_by_part_of_keys(spark):
        links = stored(aligned(segs, 2 * width), "links", "zstd")
    release(segs)

    mine = own.join(links.select("id", "links").hint("merge"), "id", "left")
    counts = stored(pair_counts(parts_with(codes, mine, n_parts)), "pair-counts", "zstd").withColumn("a", F.expr(f"link div {IDS}"))
    release()
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(most.hint("merge"), "a").select("link", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    each = links.select("id", F.explode("links").alias("link")).join(counts.hint("merge"), "link")
    sums = each.groupBy("id").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    figures = stored(links.drop("links").join(sums.hint("merge"), "id"), "segment-figures", "zstd")
    release(links)

    return summed(parts_with(codes, own.join(figures.hint("merge"), "id", "left"), n_parts), with_groups=with_groups)
