"""Best-fit packing into sequences of at most ``capacity`` tokens.

Planned on lengths, not documents: a histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) is packed best-fit decreasing on the
driver, a whole count at a time. The plan is ranges: ranks lo..hi of length l
go to sequences first.. at some offset. Pieces then take the slots by joining
on their rank within their length. Common lengths are ranked in salted groups,
whose sizes give each group its first rank, so no length meets in one task.

Documents end with ``end_id``, so the empty one has one token. Only those
longer than the capacity are cut. Null texts count as empty, null ids keep their
pieces; repeated rows are packed each. A very long text is cut into as many
pieces as it takes; ties in length take slots by id; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearbit.llm.common import slices, stored

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Rows of a length that are ranked in one group.
GROUP = 2_000
#: Slots that one row of the plan stands for at most, once the executors have cut it.
SLOTS = 10_000
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHE = 600_000

# The normaliser and the splitter that the fast way below is written for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

# Characters for which the tokenizer's normaliser and splitter are plainly lower case and these classes: ASCII and
# Latin-1 without the controls that white-space classes disagree on. Other texts go through the tokenizer whole.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xff]*")
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

# Byte-level vocabularies write a byte that is no printable Latin-1 letter as the next letter from U+0100 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes; words are encoded once while remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        #: Any other tokenizer gets all texts whole.
        self.fast = made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _PRE_TOKENIZER and not made["truncation"] and not made["padding"]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        model = self.tokenizer.model
        for word in words:  # one pre-token each: what is left is the model, on the letters that stand for bytes
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            self.known[word] = np.array([t.id for t in model.tokenize(letters)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_SPLIT.findall(t.lower()) if self.fast and _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        for _ in range(2):  # again if the memory was emptied meanwhile
            new = set().union(*(words for words in split if words)).difference(self.known)
            if not new:
                break
            self._learn(list(new))
        get = self.known.__getitem__
        return [self._whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]


@lru_cache(1)
def worker_tokens(path: str) -> WordTokens:
    """One for all tasks that a worker runs."""
    return WordTokens(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, ``ids`` of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = worker_tokens(tokenizer_path(tokenizer)), np.asarray([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), tokens.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols[:n], types, strict=False)], names[:n])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, lo, hi, first, offset, each).

    Ranks lo..hi-1 of ``length`` go to sequences from ``first`` on, ``each`` of
    them into one sequence, from ``offset``. Sequences that are filled alike
    are held as ranges, so the work depends on the lengths, not on the counts.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first, count)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, lo = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no sequence has room: open as many as it takes
                each = min(capacity // length, left)
                put(capacity, opened, max(1, left // each))
                opened += max(1, left // each)
                continue
            room = rooms[at]
            first, count = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = min(room // length, left)
            use = min(count, left // each)
            rows.append((length, lo, lo + use * each, first, capacity - room, each))
            lo, left = lo + use * each, left - use * each
            put(room - each * length, first, use)
            put(room, first + use, count - use)
    return rows


def pack(df: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of :func:`pieces` with ``sequence_id`` and ``offset``."""
    with_ids = options.get("with_ids", False)
    # Pieces without an id get a number, written with them, so that many alike are not ranked in one group.
    cut = pieces(df, capacity=capacity, **options)
    cut = stored(cut.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "pieces")
    spark = df.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows
    keys = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    if not counts:
        return cut.select(*keys, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = [0] * (capacity + 1)
    for length, n in counts.items():
        groups[length] = -(-n // GROUP)
    dealt = F.get(F.split(F.lit(",".join(map(str, groups))), ",").cast("array<int>"), F.col("length").cast("int"))
    # Rows that agree in all of these are alike, so it does not matter which takes which slot.
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    salted = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nameless"), dealt).cast("int"))
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("length", "g").orderBy(*order)) - 1)
    sizes = salted.where(dealt > 1).groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sizes.select("length", "g", (F.sum("n").over(W.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    if max(groups) > 1:
        ranked = ranked.join(before, ["length", "g"], "left")
        ranked = ranked.withColumn("r", (F.col("r") + F.coalesce("before", F.lit(0))).cast("long"))
    else:
        ranked = ranked.withColumn("r", F.col("r").cast("long"))

    # The driver makes a row for each range, whatever it stands for; executors cut the ranges and fill in the slots.
    table = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, first long, offset long, each long")
    step = F.expr(f"greatest(1, {SLOTS} div each) * each")
    table = table.withColumn("a", F.explode(F.sequence("lo", F.col("hi") - 1, step)))
    table = table.select("length", F.col("a").alias("lo"), F.least("hi", F.col("a") + step).alias("hi"), (F.col("first") + F.expr("(a - lo) div each")).alias("first"), "offset", "each")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = table.repartition(width).withColumn("r", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    k = F.col("r") - F.col("lo")
    slots = slots.select("length", "r", (F.col("first") + F.expr("(r - lo) div each")).alias("sequence_id"), (F.col("offset") + (k % F.col("each")) * F.col("length")).alias("offset"))
    return ranked.select(*keys, "r").join(slots.hint("merge"), ["length", "r"]).select(*keys, "sequence_id", "offset")
