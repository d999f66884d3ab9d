"""Corpus operators on small tables with the awkward cases: nulls in any column,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest

from prescient.llm import langid, quality
from prescient.llm.boosting import fit
from prescient.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from prescient.llm.katz import score as katz_score
from prescient.llm.maxscore import quantise, top_k
from prescient.llm.mixing import min_cost_flow, mix, shares
from prescient.llm.mphf import PerfectHash
from prescient.llm.near_dedup import near_duplicates
from prescient.llm.packing import pack, plan_bins
from prescient.llm.preference import preference_pairs
from prescient.llm.token_store import write_store
from prescient.llm.tokenizer import Encoder, public_path
from prescient.session import ready

SCHEMA = ("doc_id long, text string, lang string, source string, sha string, size long, "
          "label int, `a b` int")
LONG = "the quick brown fox " * 20_000
ROWS = [(0, "The cat sat on the mat today", "en", "a"), (1, None, None, None),
        (2, "", "en", "a"), (3, "the CAT sat on the mat today", "en", None),
        (3, "the CAT sat on the mat today", "en", None), (None, "The cat sat", None, "b"),
        (5, LONG, "en", "b"), (6, "12 34 ?!", "de", "b"), (7, "eins zwei drei vier fünf", "de", "c"),
        (8, "\x00 \t\n é è　x", "fr", "c")]
VOCABULARY = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return spark.createDataFrame([(*r, "x", 9, 1, None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact_dedup(docs, empty):
    for bits in (64, 8, 1):  # short fingerprints collide: the bytes decide
        got = exact_dedup(docs, bits).collect()
        assert len(got) == len(ROWS)
        groups = {}
        for r in ROWS:
            groups.setdefault(low(r[1]), []).append(r[0])
        for r in got:
            members = next(g for t, g in groups.items()
                           if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            keep = max((m for m in members if m is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), r.doc_id == keep)
    assert exact_dedup(empty).count() == 0


def test_golomb_round_trip():
    for n in (0, 1, 5, 4000):
        v = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        rice, code = golomb_encode(v)
        assert (golomb_decode(code, rice, v.size) == v).all()
    v = np.array([0, 1, 2, 2**64 - 1], dtype=np.uint64)
    rice, code = golomb_encode(v)
    assert (golomb_decode(code, rice, 4) == v).all()


def test_near_duplicates(spark, docs, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got[0, 3] == (0, True) and got[3, 3] == (0, False)
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True)  # empty sets link with nothing
    assert got[None, 1] == (None, True)
    assert near_duplicates(empty).count() == 0
    # A chain: neighbours are near, the ends are not.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[20 * i:20 * i + 200])) for i in range(10)]
    chain = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in chain} == {0}


def test_packing(docs, empty):
    enc = Encoder(VOCABULARY)
    rows = pack(docs, VOCABULARY, 2, capacity=64).collect()
    want = sorted(np.frombuffer(enc.encode(r[1] or ""), dtype="<u4").size + 1 for r in ROWS)
    assert sum(r.length for r in rows) == sum(want)
    seqs = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(empty, VOCABULARY, 2).count() == 0


def test_plan_places_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 65, int(rng.integers(1, 300)))
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
        bins, used, number = plan_bins(counts, 64), {}, 0
        for n, items in bins:
            assert n > 0 and sum(s * k for s, k in items) <= 64
            assert sum(k for s, k in items if s > 64 // 3) <= 2
            number += n
            for s, k in items:
                used[s] = used.get(s, 0) + n * k
        assert used == counts
        assert number <= 1.25 * -(-sum(lengths) // 64) + 1


def test_token_store(docs, empty):
    store = write_store(docs, VOCABULARY, 0, ids_below=50_257)
    got = store.read(store.lookup(docs)).collect()
    enc = Encoder(VOCABULARY)
    want = sorted((r[0] is not None, r[0] or 0, enc.encode(r[1] or "") + bytes(4)) for r in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    unknown = docs.selectExpr("doc_id + 1000 AS doc_id").where("doc_id is not null")
    assert store.lookup(unknown).count() == 0
    nothing = write_store(empty, VOCABULARY, 0)
    assert nothing.read(nothing.lookup(empty)).count() == 0


def test_pieces_equal_whole_texts():
    enc = Encoder(VOCABULARY)
    rng = np.random.default_rng(1)
    for _ in range(500):
        t = "".join(rng.choice(list(" \n\tab'1.é\x85\x1c　,;Ñ"), int(rng.integers(0, 16))))
        whole = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == np.array(whole, dtype="<u4").tobytes()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    perfect, arrays = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes(x=np.arange(3)))
    assert sorted(perfect.find(keys)) == list(range(keys.size)) and arrays["x"].tolist() == [0, 1, 2]
    assert (perfect.find(keys + np.uint64(2**63)) == -1).all()


def test_mixing(spark, docs, empty):
    got = mix(docs.selectExpr("doc_id", "text", "array(source) AS sources", "size")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix(empty.selectExpr("doc_id", "text", "array(source) AS sources")).count() == 0
    overlap = spark.createDataFrame(
        [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(40)],
        "doc_id long, text string, sources array<string>")
    taken = mix(overlap).agg({"taken": "sum"}).first()[0]
    assert taken == 400  # b's share fits into the shared half


def test_shares_and_flow():
    assert shares([100, 1, 100], [1, 2, 3], 201) == pytest.approx([49.5, 3, 148.5])
    assert shares([], [], 0) == [] and shares([0], [1], 0) == [0]
    # The shared pattern serves source 1, which has no other words; nothing repeats.
    flow = min_cost_flow([((0,), 10), ((0, 1), 10)], [10, 10])
    assert flow == {(0, 0): 10, (1, 1): 10}
    assert sum(min_cost_flow([((0,), 10)], [100]).values()) == 30


def test_langid(spark, docs, empty):
    from pyspark.sql import functions as F
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"),
                                   (None, "de"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    got = {r.doc_id: r for r in langid.predict(docs, model, F.col("doc_id")).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == "und"
    assert got[0].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([("the cat and the dog " * 30 + "der hund und die katze " * 10,)],
                                  "text string")
    r = langid.predict(mixed, model).first()
    assert r.lang_pred == "en" and 0.5 < r.score < 0.95
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none, F.col("doc_id")).collect()} == {"und"}
    assert langid.predict(empty, model, F.col("doc_id")).count() == 0


def test_quality(spark, docs, empty):
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 1), (99, 1), (None, 1), (6, None)],
                                   "doc_id long, label int")
    got = quality.score(stats, quality.train(stats, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = quality.score(stats, quality.train(stats, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.document_statistics(empty).count() == 0


def test_boosting_learns_a_corner():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000], trees=40)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.98


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(120)]
    rows += [(5, rows[5][1]), (200, None), (201, [None] * 6), (202, [float("nan")] * 6),
             (None, rows[0][1]), (203, []), (204, rows[7][1][:3])]
    v = quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                 "vec_id", "embedding")
    ready(spark)
    got = sorted(tuple(r) for r in top_k(v, v.where("id % 50 = 0"), 3, shard_rows=25,
                                         block_queries=2).collect())
    live = [(k, [int(np.floor(256 * c)) for c in e]) for k, e in rows
            if k is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    want = []
    for k, q in live:
        if k % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in live if j != k)[:3]
            want += [(k, i + 1, j, -x) for i, (x, j) in enumerate(s)]
    assert got == sorted(want)
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_katz(spark, docs, empty):
    from pyspark.sql import functions as F
    # One document "a b a" and one "a": a word that fills a whole text is followed by
    # the end or by what was seen; all probabilities after "a" sum to one.
    texts = ["a b a", "a", "a c"]
    probes = ["a", "a a", "a b", "a c", "a zzz"]
    rows = [(i, t, i < 3) for i, t in enumerate([*texts, *probes])]
    small, _ = katz_score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"))
    s = {r.doc_id: 10 ** r.score for r in small.collect()}
    assert all(0 < v < 1 for v in s.values())
    got, model = katz_score(docs.withColumn("train", F.lit(True)))
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and np.isfinite(r.score) for r in rows)
    assert model.words.n == sum(r.n_tokens for r in rows)
    cold, model = katz_score(docs.withColumn("train", F.lit(False)))
    assert model.words.n == 0 and all(r.n_known == 0 for r in cold.collect())
    assert katz_score(empty.withColumn("train", F.lit(True)))[0].count() == 0


def test_preference(spark):
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected", "rejected")]
    rows += [(1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", None),
             (2, "chosen", 0, None, "x"), (2, "rejected", 0, "user", "x"),
             (3, "chosen", None, "assistant", "a"), (None, "chosen", 0, "user", "a"),
             (4, "other", 0, "user", "a")]
    t = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: r for r in preference_pairs(t).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.prompt_turns == 1 and r.usable
    assert [r.chosen[s.start:s.end] for s in r.chosen_mask] == ["yes<|end|>\n"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_mask] == ["<|end|>\n"]
    assert got[2].prompt_turns == 1 and got[2].chosen == got[2].rejected == "" and not got[2].usable
    assert got[3].rejected == "" and not got[3].usable
    assert preference_pairs(t.limit(0)).count() == 0
