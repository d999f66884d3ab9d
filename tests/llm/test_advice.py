"""Corpus operators and pipeline stages on cases that an earlier form got wrong."""

import numpy as np
import pytest

import corpus_pipeline
from prescient.llm import langid, mixing
from prescient.llm.mixing import mix
from prescient.llm.near_dedup import near_duplicates
from prescient.llm.packing import pack
from prescient.llm.token_store import write_store
from prescient.llm.tokenizer import Encoder, public_path
from prescient.session import ready

DOCS = "doc_id long, text string, lang string, source string"
SYLLABLES = {"en": ["the", "ing", "and", "ther", "wh", "ould", "ness"],
             "de": ["sch", "ein", "ung", "lich", "ver", "zwö", "keit"]}


def prose(lang, words, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4))))
                    for _ in range(words))


def letters(words, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(words))


@pytest.fixture(scope="module")
def tagged(spark):
    ready(spark)
    rows = [(i, prose(lang, 60, i), lang, "a") for i in range(60)
            for lang in [("en", "de")[i % 2]]]
    planted = [(100, letters(60, 1), None, "a"),
               (101, "все люди рождаются свободными и равными в своем достоинстве", None, "a"),
               (102, "12 34 !! 55 t 99 -- 77", None, "a"),
               (103, prose("en", 30, 103) + " " + prose("de", 30, 104), "en", "a"),
               (104, prose("de", 5, 105), "de", "a")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(planted, DOCS)


def test_language_stage_rejects_other_text(spark, tagged):
    clean, planted = tagged
    kept = {r.doc_id for r in corpus_pipeline.language(spark, clean.union(planted), "").collect()}
    assert kept == {*range(60), 103, 104}


def test_pairs_at_the_threshold_with_few_agreements(spark):
    # 42 of 56 shingles are common; the signatures agree in 24 or 25 coordinates.
    rows = []
    for n in (3107, 6981, 9562, 9878):
        words = [f"{n}x{i}" for i in range(60)]
        rows += [(n, " ".join(words[:53])), (n + 1, " ".join(words[7:]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == \
        {i: n for n in (3107, 6981, 9562, 9878) for i in (n, n + 1)}


def test_near_stage_keeps_one_row_of_each_component(spark):
    ready(spark)
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words[i:200 + i]) for i in range(4)]
    other = [" ".join(words[i:i + 30]) for i in (240, 290, 350)]
    rows = [(7, near[0], "en", "a"), (7, near[1], "en", "a"), (None, near[2], "en", "a"),
            (7, other[0], "en", "a"), (None, other[1], "en", "a"), (None, other[2], "en", "a"),
            (None, other[2] + " more", "en", "a"), (9, "", "en", "a"), (9, None, "en", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert sum(t in near for _, t in got) == 1 and (None, near[2]) not in got
    assert sum(t in (other[2], other[2] + " more") for _, t in got) == 1
    assert {(7, other[0]), (None, other[1]), (9, ""), (9, None)} <= set(got) and len(got) == 6
    kept = [r for r in near_duplicates(docs).collect() if r.kept and r.n_shingles > 0]
    assert sum(r.component_id is None for r in kept) == 2  # one of each nameless component


def test_mixed_stage_takes_each_row_its_own_times(spark):
    ready(spark)
    rows = [(i if i % 3 else [None, 5][i % 2], f"w{i} " * (1 + i % 7), "en", "abc"[i % 3])
            for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    times = mix(docs.selectExpr("doc_id", "text", "array(source) AS sources")).collect()
    got = corpus_pipeline.mixed(spark, docs, "").collect()
    assert len(got) == sum(r.times for r in times)
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in times)


def test_added_tokens_get_the_ids_of_the_file(spark):
    from tokenizers import Tokenizer
    path = public_path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), Encoder(path)

    def want(text):
        return np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert 50256 in np.frombuffer(want("end of it <|endoftext|> and on"), dtype="<u4")
    parts = ["<|endoftext|>", " ", "a", "<|", "word's", "|>", "\n", " <|endoftext|> ", "é"]
    rng = np.random.default_rng(4)
    texts = ["end of it <|endoftext|> and on", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts, int(rng.integers(0, 9)))) for _ in range(300)]
    assert all(enc.encode(t) == want(t) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    end = np.array([2], dtype="<u4").tobytes()
    assert {r.doc_id: bytes(r.ids) for r in pack(docs, path, 2).collect()} == \
        {i: want(t) + end for i, t in enumerate(texts[:20])}
    store = write_store(docs, path, 2, ids_below=50_257)
    assert {r.doc_id: bytes(r.ids) for r in store.read(store.lookup(docs)).collect()} == \
        {i: want(t) + end for i, t in enumerate(texts[:20])}


def test_more_languages_than_taggers_have(spark):
    from pyspark.sql import functions as F
    ready(spark)
    rows = [(i, letters(20, i), f"l{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(docs)
    assert len(model.languages) == 200
    got = langid.predict(docs, model, F.col("lang")).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_more_sources_than_the_flow_takes(spark, monkeypatch):
    ready(spark)
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 5), [f"s{i // 2:03}"]) for i in range(100)]
        + [(200, "w w", ["a", "b"]), (201, "w w w", ["a"])],
        "doc_id long, text string, sources array<string>")
    whole = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)  # 52 patterns, two with shared sources
    assert sorted(map(tuple, mix(docs).collect())) == whole


def test_sets_of_languages(spark, tagged):
    from pyspark.sql import functions as F
    clean, planted = tagged
    got = {r.doc_id: r for r in
           langid.predict(planted, langid.train(clean), F.col("doc_id")).collect()}
    both = {x.lang: x.share for x in got[103].languages}
    assert set(both) == {"en", "de"} and all(0.3 < v < 0.7 for v in both.values())
    assert [x.lang for x in got[104].languages] == ["de"]
    assert got[100].rejected and not got[103].rejected and not got[104].rejected


def test_every_text_with_a_letter_has_a_learned_language(spark, tagged):
    from pyspark.sql import functions as F
    clean, _ = tagged
    model = langid.train(clean)
    texts = ["все люди рождаются", "x", "zzqx qxzz", "カナ", "1234 5678 99 a", "ñ"]
    none = [None, "", "12 34 !?", " \t\n", "\u0301"]
    docs = spark.createDataFrame(list(enumerate(texts + none)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, model, F.col("doc_id")).collect()}
    for i in range(len(texts + none)):
        assert (got[i].lang_pred in ("en", "de")) == (i < len(texts))
        assert 0 <= got[i].score <= 1 and (got[i].lang_pred != "und" or got[i].rejected)


def test_flow_is_a_cheapest_largest_one():
    """Against shortest augmenting paths by Bellman-Ford on 200 random networks."""
    def plain(patterns, quotas, repeats=3):
        end = 1 + len(patterns) + len(quotas)
        edges = []

        def edge(a, b, c, w):
            edges.extend(([a, b, c, w], [b, a, 0, -w]))
        for p, (sources, words) in enumerate(patterns):
            for r in range(repeats):
                edge(0, 1 + p, words, r)
            for x in sources:
                edge(1 + p, 1 + len(patterns) + x, 10**9, 0)
        for x, q in enumerate(quotas):
            edge(1 + len(patterns) + x, end, q, 0)
        sent = cost = 0
        while True:
            far, came = {0: 0}, {}
            for _ in range(end + 1):
                for i, (a, b, c, w) in enumerate(edges):
                    if c and a in far and far[a] + w < far.get(b, 10**9):
                        far[b], came[b] = far[a] + w, i
            if end not in far:
                return sent, cost
            path, at = [], end
            while at:
                path.append(came[at])
                at = edges[came[at]][0]
            push = min(edges[i][2] for i in path)
            for i in path:
                edges[i][2] -= push
                edges[i ^ 1][2] += push
            sent, cost = sent + push, cost + push * far[end]

    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        patterns = [(tuple(sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())),
                     int(rng.integers(0, 12))) for _ in range(int(rng.integers(0, 6)))]
        quotas = rng.integers(0, 30, n).tolist()
        flow = mixing.min_cost_flow(patterns, quotas)
        words, into = [0] * len(patterns), [0] * n
        for (p, x), v in flow.items():
            assert v > 0 and x in patterns[p][0]
            words[p] += v
            into[x] += v
        assert all(v <= 3 * w for v, (_, w) in zip(words, patterns, strict=True))
        assert all(v <= q for v, q in zip(into, quotas, strict=True))
        cost = sum(max(0, v - r * w) for v, (_, w) in zip(words, patterns, strict=True) for r in (1, 2))
        assert (sum(words), cost) == plain(patterns, quotas)


def test_every_source_goes_through_the_flow(spark, monkeypatch):
    from conftest import SMALL
    from prescient.llm.q_mix import op1_mix
    seen = []

    def spy(patterns, quotas, repeats):
        seen.append((patterns, quotas))
        return flow(patterns, quotas, repeats)
    flow = mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", spy)
    rows = op1_mix(spark, SMALL).count()
    sources = spark.read.parquet(f"{SMALL}/documents.parquet").select("source").distinct().count()
    assert rows and len(seen) == 1
    assert len(seen[0][0]) == len(seen[0][1]) == sources


def test_sources_come_near_their_targets_with_repeated_rows(spark):
    ready(spark)
    rows = [(1, "w " * 10, "a") for _ in range(150)] + [(1, "w " * 10, "b") for _ in range(40)]
    rows += [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(300)] + [(None, "w " * 5, "b")] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string").repartition(7)
    got = mix(docs.selectExpr("doc_id", "text", "array(s) AS sources", "s"), number="s").collect()
    assert len(got) == len(rows)
    for source in "ab":
        mine = [r for r in got if r.s == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    again = mix(docs.coalesce(2).selectExpr("doc_id", "text", "array(s) AS sources")).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again) == \
        sorted((r.doc_id or -1, r.size, r.taken) for r in got)


def test_quality_learns_although_one_id_repeats(spark):
    from prescient.llm import quality
    ready(spark)
    rows = [(7, prose("en", 5 + i % 3, i)) for i in range(400)]
    rows += [(100 + i, prose(("en", "de")[i % 2], 30, i)) for i in range(60)]
    stats = quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, i % 2) for i in range(60)],
                                   "doc_id long, label int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda x, y: seen.append((x.shape, y.tolist())) or fit(x, y)
        quality.train(stats, labels)
        quality.train(stats, labels, sample_rows=20)
    finally:
        quality.fit = fit
    assert seen[0][0][0] == 61 and sum(seen[0][1]) == 31
    assert seen[1][0][0] == 20


def test_quality_held_out(spark):
    """Ranking of held-out labelled documents of sf0.01, by the query."""
    from conftest import MEDIUM
    from prescient.llm.q_quality import op4_quality
    labels = {r.doc_id: r.quality for r in
              spark.read.parquet(f"{MEDIUM}/labels.parquet").where("quality is not null").collect()}
    got = [(r.score, labels[r.doc_id]) for r in op4_quality(spark, MEDIUM).collect()
           if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


def test_langid_held_out(spark):
    from conftest import MEDIUM
    from prescient.llm.q_lang import op10_langid
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = [r for r in op10_langid(spark, MEDIUM).collect() if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.95
