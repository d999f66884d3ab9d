"""Stages exact and packed, and the chain, against plain versions."""

from collections import Counter

import numpy as np

import corpus_pipeline
from conftest import SMALL
from prescient.llm.tokenizer import public_path
from prescient.session import ready

DOCS = "doc_id long, text string, lang string, source string, `a b` int"


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_stage_keeps_the_largest_id_of_equal_texts(spark):
    ready(spark)
    rows = [(1, "One Text", "en", "a", 1), (4, "one text", "en", "a", 2), (2, "ONE text", None, "b", 3),
            (3, None, "en", "a", 4), (5, "", "de", "a", 5), (6, "other", "de", None, 6),
            (None, "no id", "de", "a", 7), (7, "É", "fr", "a", 8), (8, "é", "fr", "a", 9),
            (9, "twice", "en", "a", 1), (9, "twice", "en", "a", 1)]
    got = corpus_pipeline.exact(spark, spark.createDataFrame(rows, DOCS), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "a b"]
    keep = {}
    for r in rows:
        k = low(r[1])
        if k not in keep or (r[0] or -1) > (keep[k][0] or -1):
            keep[k] = r
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in keep.values())


def test_exact_stage_agrees_however_rows_are_dealt(spark):
    ready(spark)
    rows = [(9, "Twice", "en", "a", 1), (9, "twice", "de", "b", 2), (9, "TWICE", None, None, None),
            (None, "none", "en", "a", 1), (None, "None", "de", "a", 2), (3, "twice", "en", "a", 1)]
    runs = []
    for order, parts in ((rows, 1), (rows[::-1], 4), (rows[2:] + rows[:2], 3)):
        docs = spark.createDataFrame(order, DOCS).repartition(parts)
        runs.append(sorted(map(str, map(tuple, corpus_pipeline.exact(spark, docs, "").collect()))))
    assert len(runs[0]) == 2 and runs[0] == runs[1] == runs[2]
    assert set(runs[0]) <= set(map(str, rows))
    empty = corpus_pipeline.exact(spark, spark.createDataFrame([], DOCS), "")
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "source", "a b"]


def test_packed_stage_and_chain(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    stages = {}
    ready(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        stages[name] = [r.asDict() for r in docs.collect()]
        if name != "packed":
            assert docs.columns == before.columns
    table = Counter(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    for name in ("language", "exact", "near"):  # rows go, none is made or changed
        assert not Counter(r["doc_id"] for r in stages[name]) - table
    assert len({low(r["text"]) for r in stages["exact"]}) == len(stages["exact"])
    assert len(stages["language"]) >= len(stages["exact"]) >= len(stages["near"]) > 0
    assert max(Counter(r["doc_id"] for r in stages["mixed"]).values()) <= 3
    assert {r["doc_id"] for r in stages["mixed"]} <= {r["doc_id"] for r in stages["near"]}
    # The pieces are the ids of the mixed documents, end included, in gapless sequences.
    want = Counter()
    for r in stages["mixed"]:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.update({r["doc_id"]: len(ids)})
    got, places = Counter(), {}
    for r in stages["packed"]:
        got.update({r["doc_id"]: r["length"]})
        assert np.frombuffer(r["ids"], dtype="<u4").size == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for piece in places.values():
        at = 0
        for offset, length in sorted(piece):
            assert offset == at
            at += length
        assert at <= 1024
