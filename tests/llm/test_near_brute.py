"""Near duplicates against all pairs, and the bound of the last round."""

import random

import numpy as np
import pyarrow as pa

from prescient.llm import near_dedup
from prescient.llm.near_dedup import near_duplicates, shingle_sets
from prescient.session import ready


def components_of(texts, percent=75):
    """Smallest number reachable over pairs of at least ``percent``, from all pairs."""
    sets = [set(x.tolist()) for x in shingle_sets(pa.array(texts))]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    both = {}
    for holders in index.values():
        for k, i in enumerate(holders):
            for j in holders[k + 1:]:
                both[i, j] = both.get((i, j), 0) + 1
    close = 0
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            label[b] = a
            close += 1
    return [find(i) for i in range(len(texts))], close


def test_all_pairs_of_two_thousand_texts(spark):
    ready(spark)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3_000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]
    passages = [prose(150) for _ in range(2)]
    texts = []
    while len(texts) < 2_000:
        kind = rng.random()
        if kind < 0.15:  # shares a passage, not near: long postings
            t = rng.choice(passages) + prose(rng.randint(35, 60))
        elif kind < 0.6 and texts:  # an altered copy, about the threshold and above
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = prose(rng.choice([2, 5, 20, 60, 120]))
        texts.append(" ".join(t))
    want, close = components_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, block=3).collect()}
    assert close > 300 and len(set(want)) < 1_900
    # The signature may leave out a pair at the threshold (4e-6 each); none here.
    assert [got[i] for i in range(len(texts))] == want


def test_texts_that_share_a_passage_are_not_dealt(spark):
    ready(spark)
    rng = np.random.default_rng(2)
    dealt = []
    bounded = near_dedup.bounded

    def spy(postings, *rest):
        left = bounded(postings, *rest)
        dealt.append((postings.count(), left.count()))
        return left
    near_dedup.bounded = spy
    try:
        for n in (200, 400):
            rows = [(i, " ".join([*(f"p{k}" for k in range(150)),
                                  *(f"x{v}" for v in rng.integers(0, 10**9, 40))])) for i in range(n)]
            got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=20)
            assert {r.component_id for r in got.collect()} == set(range(n))
    finally:
        near_dedup.bounded = bounded
    assert all(before > 1_000 and after == 0 for before, after in dealt) and len(dealt) == 2
