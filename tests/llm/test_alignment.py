"""Alignment against whole texts encoded by both libraries, on odd rows, random strings and an empty table."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from nearbit.llm import alignment, queries
from nearbit.llm.common import table
from nearbit.llm.packing import tokenizer_path


def letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tokens_of():
    a = Tokenizer.from_file(tokenizer_path(alignment.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.SECOND))
    byte = letters()

    def run(text):
        """[(id, start, end)] of both, or two empty lists."""
        if not text:
            return [], []
        first = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(byte[c] for c in t)) for i, t in zip(first.ids, first.tokens, strict=True)]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        raw = (" " + text).encode()
        if any(b"".join(x for _, x in side) != raw for side in (one, two)):
            return [], []
        out = []
        for side in (one, two):
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    return run


def brute(rows, tokens_of):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row."""
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b = tokens_of(text)
        links, j = [], 0
        for i, lo, hi in a:
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, start = [], 0
        for c in cuts:
            said.append("|".join(",".join(str(i) for i, lo, _ in side if start <= lo < c) for side in (a, b)))
            start = c
        docs.append((doc_id, len(a), len(b), len(cuts), links, ";".join(said)))
        held.update(set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return Counter((d, na, nb, ng, len(ls), sum(held[x] == most[x[0]] for x in ls), sum(held[x] for x in ls), g) for d, na, nb, ng, ls, g in docs)


def got(df):
    return Counter(map(tuple, alignment.align(df, with_groups=True).collect()))


def test_odd_rows(spark, odd, none, tokens_of):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 50_000] + [(20 + i, t) for i, t in enumerate(["▁", "a▁b", " ", "  ", "\n", "\n\n", " \n \n x", "a\n", "a \n\n\nb", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll 'S", "x" * 3000, "中文字" * 300, "a\tb\t c", "a\x1cb \x85c\xa0d　e", "\x00\x01", "🙂🙃 é", "a" * 50 + " b" * 50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows, tokens_of)
    long = odd.where("doc_id = 7")
    assert alignment.align(long).first()["n_a"] > 30_000
    assert alignment.align(none).count() == 0
    assert alignment.align(odd).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_random_strings(spark, tokens_of):
    """White space of all kinds, special strings, marks, scripts and controls in any order."""
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "'s", "'", "don't", "Word", "ing", "123", "4", "...", "!?", "é", "é", "中", "文字", "😀", "<s>", "<0x0A>", "<|endoftext|>", "ß", "_", "-", "$$", "ﬁ", "й", "שלום", "\x00", "the", "token", "A", "▁"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(3000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows, tokens_of)


def test_small_parts(spark, tokens_of, monkeypatch):
    """A task that starts its numbering anew many times gives the same."""
    monkeypatch.setattr(alignment, "SEGMENTS", 5)
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else i % 400, " ".join(rng.choices(["one", "Two,", "three-four", "fünf", "6"], k=rng.randrange(0, 12)))) for i in range(1500)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, tokens_of)


def test_query(spark, small, tokens_of):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = Counter((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute(rows, tokens_of).elements())
    assert Counter(map(tuple, queries.QUERIES["op11_alignment"](spark, small).collect())) == want


def test_plan(spark, small):
    """The relational part needs one exchange a side and one of the merged rows, and a join on segment and end."""
    segs = spark.createDataFrame([(1, [1, 2], [1, 1], [3], [2])], "id long, a array<int>, a_len array<int>, b array<int>, b_len array<int>")
    with alignment.dealt_by_part_of_keys(spark):
        made = alignment.aligned(segs, 4)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[1:] for r in made.collect()] == [(2, 1, 1, 2, "1,2|3", [2 * alignment.IDS + 3, alignment.IDS + 3])]
    assert plan.count("Exchange hashpartitioning(") == 3 and "SortMergeJoin [id" in plan and "FullOuter" in plan and "Cartesian" not in plan
