"""Periodic runs, benchmark decontamination and spelling variants: brute force on small
inputs, and nulls, empty and long texts, ties, repeated rows, empty tables and clashing
columns."""

import hashlib
import itertools
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from prescient.llm import decontaminate as leaks
from prescient.llm import periodic, q_leaks, q_periodic, q_spelling, spelling
from prescient.session import ready

SCHEMA = "doc_id long, text string, start string, key string, word int, items string, `a b` int"
LONG = "the quick brown fox jumps over it " * 4_000
TEXTS = [(0, "one two three " * 9), (1, None), (2, ""), (3, " \t\n"), (3, "a a a a a a a a a a a a"),
         (3, "a a a a a a a a a a a a"), (None, "x y " * 20 + "x"), (7, LONG), (8, "a b c d"),
         (9, "é è é è é è é è é è é è\x00 é"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return spark.createDataFrame([(*r, "s", "k", 1, "i", None) for r in TEXTS], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --------------------------------------------------------------- periodic runs

def runs_of(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            r = w[i:j + q]
            if j > i and len(r) >= max(least, 2 * q) and \
                    not any(r[:-p] == r[p:] for p in range(1, q)):
                out.append((i, len(r), q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed_of(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts, least):
    row, *rest = periodic.find_runs(np.array([x for t in texts for x in t], dtype=np.int64),
                                    np.array([len(t) for t in texts]), least)
    out = [[] for _ in texts]
    for r, *x in zip(row, *rest, strict=True):
        out[r].append(tuple(int(v) for v in x))
    return out


def test_runs_of_all_short_binary_texts():
    for n in range(13):
        texts = list(itertools.product((0, 1), repeat=n))
        assert found(texts, 2) == [runs_of(t, 2) for t in texts]


def test_runs_of_random_texts():
    rng = random.Random(5)
    texts = [()]
    for _ in range(300):
        letters, t = rng.choice([2, 2, 3, 40]), []
        while len(t) < rng.randint(5, 120):
            t += [rng.randrange(letters) for _ in range(rng.randint(1, 11))] * rng.randint(1, 6)
        texts.append(tuple(t[:160]))
    fib = [(0,), (0, 1)]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1], (0,) * 700, ((0,) * 10 + (1,)) * 60]
    for least in (2, 12):
        assert found(texts, least) == [runs_of(t, least) for t in texts]


def test_collapse(docs):
    for rows in (docs, docs.limit(0)):
        got = periodic.collapse_runs(rows, rows["doc_id"], rows["start"], rows["text"]).collect()
        want = Counter()
        for i, t in TEXTS if rows is docs else []:
            r = runs_of(words_of(t), 12) if t != LONG else [(0, 28_000, 7)]
            want[i, t, "s", tuple(r), collapsed_of(words_of(t), r)] += 1
        assert Counter((x.doc_id, x.text, x.start, tuple(tuple(r) for r in x.runs), x.collapsed)
                       for x in got) == want


def plant(i, w):
    if i is None or not w:
        return w
    h = crc32(str(i).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def test_query_of_runs(spark):
    got = {r.doc_id: r for r in q_periodic.op11_periodic_runs(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    several = 0
    for i, t in rows:
        w = plant(i, words_of(t))
        if len(w) > 2_000:
            continue
        runs = runs_of(w, 12)
        several += len(runs) > 0
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        sha = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        text = hashlib.sha256(collapsed_of(w, runs).encode()).hexdigest()
        assert (got[i].n_runs, got[i].start, got[i].length, got[i].period, got[i].exponent_milli,
                got[i].runs_sha256, got[i].collapsed_sha256) == \
            (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha, text)
    assert several > 10


def test_planting_without_ids_or_words(docs):
    got = q_periodic.planted(docs).collect()
    assert Counter((r.doc_id, " ".join(words_of(r.text))) for r in got) == \
        Counter((i, " ".join(plant(i, words_of(t)))) for i, t in TEXTS)


# --------------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def leaks_of(text, bench):
    """(words, spans of words, items) by brute force."""
    w = WORD.findall(low(text))
    hit, items = set(), set()
    for item, t in bench:
        b = WORD.findall(low(t))
        k = min(len(b), 10)
        grams = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in grams:
                hit.update(range(i, i + k))
                if item is not None:
                    items.add(str(item))
    return len(w), hit, sorted(items)


def hits(spans):
    return {i for s, e, *_ in spans for i in range(s, e)}


BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None),
         (3, ""), (10, "Short ITEM, here"), (9, "short item here"), (9, "é è ü"), (None, "no id at all"),
         (4, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (5, "?! ..."),
         (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
DOCS = [(0, "x Alpha-BETA gamma\ndelta epsilon zeta eta theta iota kappa lambda mu y"), (1, None), (2, ""),
        (3, "a short item here short item here b"), (None, "É è ü é è ü no ID at all"), (3, "?"),
        (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, "short item"),
        (6, "short item\x00here" + " w" * 3_000 + " SHORT item here"), (6, "é è ü")]


def test_leaks(spark):
    ready(spark)
    bench = spark.createDataFrame([(*r, 1) for r in BENCH], "item_id long, text string, block int")
    docs = spark.createDataFrame([(*r, "k", 1) for r in DOCS],
                                 "doc_id long, text string, items string, spans int")
    want = Counter()
    for i, t in DOCS:
        n, hit, items = leaks_of(t, BENCH)
        want[i, t, n, tuple(sorted(hit)), tuple(items)] += 1
    for item_bytes, part in ((1 << 20, 1 << 20), (1 << 20, 50), (30, 1 << 20), (70, 60)):
        got = leaks.find_leaks(docs, bench, docs["doc_id"], docs["text"].alias("t"),
                               item_bytes=item_bytes, part=part).collect()
        assert Counter((r.doc_id, r.t, r.n_words, tuple(sorted(hits(r.spans))), tuple(r.items))
                       for r in got) == want
        for r in got:  # the same stretches as bytes
            raw = (r.t or "").encode()
            cut = [low(raw[s.first_byte:s.end_byte].decode()) for s in r.spans]
            words = WORD.findall(low(r.t))
            assert [WORD.findall(c) for c in cut] == [words[s.start:s.end] for s in r.spans]
    assert leaks.find_leaks(docs.limit(0), bench, F.col("doc_id")).count() == 0
    clean = leaks.find_leaks(docs, bench.limit(0), F.col("doc_id")).collect()
    assert len(clean) == len(DOCS) and not any(r.spans or r.items for r in clean)
    # What is left holds no window; clean rows stay as they are, all columns too.
    left = leaks.decontaminate(docs, bench, "documents")
    assert left.columns == docs.columns
    assert Counter(r.text for r in left.collect()) == \
        Counter(t for _, t in DOCS if not leaks_of(t, BENCH)[1])
    cut = leaks.decontaminate(docs, bench).collect()
    assert len(cut) == len(DOCS)
    assert all(r["items"] == "k" and r.spans == 1 for r in cut)
    texts = {r.text for r in cut}
    assert {None, "", "?", "x  y", "a  b", "short item"} <= texts


def test_leaks_in_random_texts():
    rng = random.Random(2)

    def text(n):
        return " ".join(rng.choice("abc") for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 3, 12, 15, 30]) + 8)) for i in range(20)]
    grams = leaks.Grams([str(i) for i, _ in bench], [t for _, t in bench])
    texts = [text(rng.randint(0, 400)) for _ in range(60)]
    for batch, part in ((pa.array(texts), 1 << 20), *((pa.array([t]), 64) for t in texts)):
        for t, (n, spans, items) in zip(batch.to_pylist(), leaks.scan(grams, batch, part),
                                           strict=True):
            words, hit, who = leaks_of(t, bench)
            assert (n, hits(spans), sorted(grams.ids[i] for i in items)) == (words, hit, who)


def test_equal_hashes_are_told_apart_by_words():
    grams = leaks.Grams(["1"], ["one two three four"])
    hashes, *rest = grams.sets[4]
    words = leaks.Words(np.frombuffer(b"five six seven eight", dtype=np.uint8), np.array([0, 20]))
    _, h = words.windows(4)
    seen = np.ones_like(rest[-1])
    grams.sets[4] = (h.copy(), *rest[:-1], seen)
    assert not list(grams.hits(words))


def test_query_of_leaks_finds_planted(spark):
    got = q_leaks.op12_decontaminate(spark, SMALL).collect()
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


# ------------------------------------------------------------- spelling variants

def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants_of(words, ratio=5):
    out = {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] < ratio * n:
            best = None
        out[w] = (n, len(others), best)
    full = {}
    for w, (n, k, f) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        full[w] = (n, k, f, None if f is None else words[f], root)
    return full


def test_variants_equal_brute_force(spark):
    ready(spark)
    rng = random.Random(4)
    words = {}
    for letters, sizes in (("ab", (6, 9)), ("abcdé", (6, 7)), ("aÀz", (7, 8))):
        for _ in range(150):
            words["".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))] = \
                rng.choice([5, 5, 6, 25, 30, 150, 800, 10**6])
    base = "longword" * 30
    for i in (0, 1, 60, 120, 239):  # beyond PLAIN: by hashes
        words[base[:i] + "x" + base[i + 1:]] = 6
        words[base[:i] + base[i + 1:]] = 5
    words[base] = 40
    for n in (63, 64, 65, 66):
        words["q" * n] = 5 ** (n - 60)
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, near int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root)
           for r in spelling.variants(table).collect()}
    assert got == variants_of(words)
    chain = spark.createDataFrame([("aaaaaa" + "b" * i, 5 ** (i + 1)) for i in range(20)],
                                  "word string, n long")
    assert {r.root for r in spelling.variants(chain).collect()} == {"aaaaaa" + "b" * 19}
    assert spelling.variants(table.limit(0)).count() == 0


def test_vocabulary(docs, spark):
    rows = [(1, "Straße straße STRASSE " * 3), (1, "Straße straße STRASSE " * 3), (None, None), (2, ""),
            (3, "abcdef-ABCDEF abcdéf×÷ÿ" + " Élan" * 6), (None, "abcdefg " * 7), (4, "x" * 50)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    for alter in (None, q_spelling.planted):
        want = Counter()
        for i, t in rows:
            for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
                w = low(run)
                w = alter(None if i is None else str(i), w) if alter else w
                if len(w) >= 4:
                    want[w] += 1
        want = {w: n for w, n in want.items() if n >= 2}
        for part in (1 << 20, 3):
            got = spelling.vocabulary(table, alter=alter, least=4, least_count=2, part=part)
            assert {r.word: r.n for r in got.collect()} == want
    assert spelling.vocabulary(table.limit(0)).count() == 0


def test_planted_code_point():
    word = next(w for w in ("é" * 4 + str(i).translate({48 + k: 97 + k for k in range(10)})
                            for i in range(5_000)) if crc32(f"12:{w}".encode()) % 199 == 0)
    at = crc32(f"12:{word}".encode()) % len(word)
    assert q_spelling.planted("12", word) == word[:at] + word[at + 1:]
    assert q_spelling.planted(None, word) == word


def test_rotations_by_hash_meet_like_text():
    a, b = "abcdefgh" * 10, "abcdefgh" * 9 + "abXdefgh"
    for plain in (4, 64, 200):
        keys_a = {k for k, kind in spelling.rotations(a, plain) if kind}
        keys_b = {k for k, kind in spelling.rotations(b, plain) if kind}
        assert len(keys_a & keys_b) == 1
        shorter = {k for k, kind in spelling.rotations(a[:40] + a[41:], plain) if not kind}
        assert len({k for k, kind in spelling.rotations(a, plain) if kind == 2} & shorter) == 1
