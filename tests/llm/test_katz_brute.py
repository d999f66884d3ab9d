"""The Katz model of two and three words against one of plain dictionaries, built from the text."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from prescient.llm import katz

K = 5
START, END = "<start>", "<end>"


def factors(counts):
    """Good-Turing factor of each count 1..K; half a count off where it gives none."""
    n = Counter(counts)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    out = {}
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Plain:
    def __init__(self, texts):
        docs = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in
                 re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [END] for t in texts]
        self.words = Counter(w for d in docs for w in d)
        self.n = sum(self.words.values())
        self.contexts = Counter(c for d in docs for c in [START, *d[:-1]])
        self.after = defaultdict(Counter)
        for d in docs:
            for c, w in zip([START, *d[:-1]], d, strict=True):
                self.after[c][w] += 1
        self.pairs = defaultdict(Counter)  # what follows two words, of which the first may be the start
        for d in docs:
            for c, v, w in zip([START, *d], d[:-1], d[1:]):
                self.pairs[c, v][w] += 1
        self.d1 = factors(self.words.values())
        self.d2 = factors(c for x in self.after.values() for c in x.values())
        self.d3 = factors(c for x in self.pairs.values() for c in x.values())
        taken = sum((1 - self.d1.get(c, 1.0)) * c for c in self.words.values())
        self.unseen = taken / self.n if taken else 1 / (self.n + 1)
        self.scale = 1.0 if taken else 1 - self.unseen

    def one(self, w):
        c = self.words[w]
        return self.scale * self.d1.get(c, 1.0) * c / self.n if c else self.unseen

    def backed(self, seen, n, factor, w, lower):
        if not n:
            return lower(w)
        kept = sum(factor.get(k, 1.0) * k for k in seen.values()) / n
        whole = kept > 1 - 1e-9  # no count is discounted: n / (n + 1) of it stays
        if w in seen:
            p = factor.get(seen[w], 1.0) * seen[w] / n
            return p * n / (n + 1) if whole else p
        left = 1 / (n + 1) if whole else 1 - kept
        return left / (1 - sum(lower(x) for x in seen)) * lower(w)

    def two(self, c, w):
        # What is seen of an end as a context counts all its occurrences in training.
        n = len(self.after) and (self.contexts[c] if c == START else self.words[c])
        return self.backed(self.after.get(c, {}), n, self.d2, w, self.one)

    def three(self, c, v, w):
        """``c`` None: ``v`` is the start of the text."""
        if c is None:
            return self.two(v, w)
        seen = self.pairs.get((c, v), {})
        return self.backed(seen, sum(seen.values()), self.d3, w, lambda x: self.two(v, x))

    def text(self, words, order):
        before = [START, *words[:-1]]
        if order == 2:
            return sum(math.log10(self.two(c, w)) for c, w in zip(before, words, strict=True))
        return sum(math.log10(self.three(c, v, w)) for c, v, w in
                   zip([None, *before[:-1]], before, words, strict=True))


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["A", "É", "été"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 25))) for _ in range(n)]
    return texts + [None, "", "W1 w1\tW1", texts[0], texts[0], "only here", "w0 " * 400]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("seed,n,vocabulary,buckets", [(1, 200, 40, 50), (2, 60, 400, 2_000_000),
                                                       (3, 3, 5, 10)])
def test_scores_equal_the_dictionary_model(spark, seed, n, vocabulary, buckets, order):
    texts = corpus(seed, n, vocabulary)
    rows = [(i, t, i % 4 != 1) for i, t in enumerate(texts)]
    plain = Plain([t for _, t, train in rows if train])
    got, model = katz.score(
        spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(5), buckets, order)
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(rows) and model.words.n == plain.n and model.words.v == len(plain.words)
    for i, t, train in rows:
        d = [w.translate({x: x + 32 for x in range(65, 91)}) for w in
             re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [END]
        r = got[i]
        assert (r["train"], r["n_tokens"]) == (train, len(d))
        assert r["n_known"] == sum(w in plain.words for w in d)
        base = sum(math.log10((plain.words[w] + 1) / (plain.n + len(plain.words) + 1)) for w in d)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(plain.text(d, order), rel=1e-9), (i, t)


def test_the_plain_model_sums_to_one():
    plain = Plain(corpus(1, 200, 40))
    for c in [START, *list(plain.words)[:20]]:
        if c != END:
            total = sum(plain.two(c, w) for w in plain.words) + plain.two(c, "nowhere")
            assert total == pytest.approx(1.0)
    for c, v in list(plain.pairs)[:20]:
        total = sum(plain.three(c, v, w) for w in plain.words) + plain.three(c, v, "nowhere")
        assert total == pytest.approx(1.0)


def test_three_words_without_rows_or_training(spark):
    schema = "doc_id long, text string, train boolean"
    assert katz.score(spark.createDataFrame([], schema), order=3)[0].count() == 0
    rows = [(1, "a b a b", False), (2, None, None), (None, "a", False), (1, "", False)]
    cold, model = katz.score(spark.createDataFrame(rows, schema), order=3)
    assert model.words.n == 0
    assert all(r["n_known"] == 0 and r["score"] <= 0 for r in cold.collect())
    with pytest.raises(ValueError):
        katz.score(spark.createDataFrame(rows, schema), order=4)
