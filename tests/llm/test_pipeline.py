import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import PLAIN, disclosure_brute, hits_brute, llr_brute, near_brute, quality_brute, texts, valid

import corpus_pipeline
from nearbit.llm import packing, pii, quality
from nearbit.llm.common import table


def sanitised_brute(rows):
    for (key, text), told in zip(rows, disclosure_brute(rows), strict=True):
        spans = {(m.start(), m.end(), k) for k in pii.KINDS for m in re.finditer(PLAIN[k], text) if valid(k, m.group())}
        mail = [(s, e) for s, e, k in spans if k == "email"]
        for m in re.finditer(r"[^\W\d_]+", text):
            action = told.get(m.group().lower())
            if action and not any(s < m.end() and m.start() < e for s, e in mail):
                spans.add((m.start(), m.end(), action))
        merged = []
        for s, e, k in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in reversed(merged):
            text = text[:s] + pii.TAGS[k] + text[e:]
        yield key, text


def pieces_brute(rows):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for key, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[at : at + 4096], "<u4")
            out[key, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def test_run_against_brute_force(spark, small):
    rows = texts(table(spark, small, "documents"))
    good = {r.doc_id for r in table(spark, small, "labels").where("quality = 1").collect()}
    left = [[r for r, x in zip(rows, llr_brute(rows, good, quality.BUCKETS), strict=True) if not quality_brute(r[1])[5] and x >= quality.THRESHOLD]]
    firsts = {key for key, _, least in near_brute(left[-1], 5, 80) if key == least}
    left.append([r for r in left[-1] if r[0] in firsts])
    hit = {key for key, _, n, *_ in hits_brute(left[-1], [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]) if n}
    left.append([r for r in left[-1] if r[0] not in hit])
    left.append(list(sanitised_brute(left[-1])))
    assert len(rows) > len(left[0]) > len(left[1]) > len(left[2]) and left[2] != left[3]  # each stage acts
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_brute(left[3])
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096


def test_each_stage_acts_on_what_is_left(spark, small):
    docs = table(spark, small, "documents")
    ids = [set() for _ in corpus_pipeline.STAGES]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, small)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = corpus_pipeline.stored(after, "test")
        ids[k] = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids[k] <= {r.doc_id for r in docs.select("doc_id").collect()} and ids[k]
        docs = after
    assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.]'").count() == 0
    last = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids[3]


def test_odd_rows(spark, odd, none, small):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, small).count() <= df.count() + 10


#: What the stages call their own columns on the way.
INNER = ["_w", "_h1", "_lines", "_mark", "_edits", "_repeats", "_t", "kept", "llr", "n_words", "key", "rep", "doc", "h"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_clashing_columns_pass_through(spark, small, name, stage):
    plain = table(spark, small, "documents").where("doc_id < 60")
    wide = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in INNER])
    after = stage(spark, wide, small)
    rows, bare = after.collect(), stage(spark, plain, small).collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert after.columns == wide.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in INNER)
    own = ["doc_id", "text"] if "text" in after.columns else ["doc_id", "piece", "ids_crc32"]
    assert sorted(tuple(str(r[c]) for c in own) for r in rows) == sorted(tuple(str(r[c]) for c in own) for r in bare)


def test_rows_without_an_id_are_judged_too(spark, small):
    text = " ".join(f"word{i}" for i in range(60))
    item = table(spark, small, "benchmark").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, text), (3, text), (3, text), (4, None), (None, item), (5, "clean"), (5, item)], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, small)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 4, 5, 5]
    left = corpus_pipeline.decontamination(spark, docs, small).collect()
    assert Counter(r.doc_id for r in left) == Counter([1, 2, None, None, 3, 3, 4, 5])
