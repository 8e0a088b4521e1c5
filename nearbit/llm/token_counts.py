"""Token counts by a two-tier lookup, all on the map side.

Texts fall into pre-tokens that the tokenizer's merges never cross: a run of
spaces with the word after it, or a line break with the word after it. The
lengths of frequent ones are broadcast as a compact table; what the table lacks
is encoded by the library and remembered by the worker, for all the tasks that
it runs, up to a bound. Pre-tokens are never shuffled: one task counts those of
about ``SAMPLE`` whole texts, by a hash of the text, and sends the ``TABLE``
most frequent with their lengths to the driver. The table decides what is fast,
never what is counted; every text is counted whole.

Null text counts as empty: 0 bytes, 0 tokens. Rows without an id, repeated rows
and empty tables are counted like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import slices
from nearbit.llm.packing import tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Entries of the broadcast table, and texts that are read to fill it.
TABLE, SAMPLE = 32_768, 2_000
#: Entries that are counted for the table, and that a worker remembers, at a time.
CACHE = 500_000

#: The mark that stands for a space inside pieces; a text's own are spaces to the tokenizer.
MARK = "▁"
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """The text, with the space that the tokenizer puts before it, in parts that are encoded independently."""
    return PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else []


class PieceLengths(dict):
    """pre-token -> its number of tokens: the table's, and what was encoded since."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.first: dict[str, int] = {}
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check()

    def start_from(self, table: dict[str, int]) -> PieceLengths:
        if self.first is not table:
            self.first = table
            self.update(table)
        return self

    def check(self) -> None:
        """No piece may join what the pre-tokens part."""
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses pre-tokens")

    def learn(self, missing: list[str]) -> None:
        if len(self) + len(missing) > CACHE + len(self.first):
            self.clear()
            self.update(self.first)
        # The library puts one space before what it gets.
        got = self.model.encode([m[1:] if m[0] == " " else m for m in missing], num_threads=1)
        self.update((m, len(g) - (m[0] == "\n")) for m, g in zip(missing, got, strict=True))
        self[" "] = 1  # alone, the library gets nothing and adds nothing

    def totals(self, texts: list[str]) -> list[int]:
        parts = [pre_tokens(t) for t in texts]
        for _ in range(2):  # again if the memory was emptied meanwhile
            if missing := [p for p in set().union(*parts) if p not in self]:
                self.learn(missing)
        get = self.__getitem__
        return [sum(map(get, ps)) for ps in parts]


@lru_cache(1)
def worker_lengths(path: str) -> PieceLengths:
    """One for all tasks that a worker runs."""
    return PieceLengths(path)


def frequent(df: DataFrame, text: str, tokenizer: str = TOKENIZER, table: int = TABLE, sample: int = SAMPLE) -> dict[str, int]:
    """The most frequent pre-tokens of a sample, with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                seen.update(pre_tokens(t))
            if len(seen) > CACHE:
                seen = Counter(dict(seen.most_common(CACHE // 4)))
        best, known = [w for w, _ in seen.most_common(table)], worker_lengths(tokenizer_path(tokenizer))
        if missing := [w for w in best if w not in known]:
            known.learn(missing)
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), pa.array([known[w] for w in best], pa.int64())], ["part", "n"])

    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    share = sample / max(1, df.count())
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else texts
    # The limit only matters if copies of one text make the sample too large; it also brings the sample to one task.
    counted = picked.limit(2 * sample).repartition(1).mapInArrow(run, "part string, n long")
    return {r["part"]: r["n"] for r in counted.collect()}


def token_counts(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(frequent(df, text, tokenizer, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_lengths(tokenizer_path(tokenizer)).start_from(shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.totals([t or "" for t in batch.column(2).to_pylist()]), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
