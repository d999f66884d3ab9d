"""Katz backoff language model of two or three words, counted and scored on packed
chunks.

Texts are cut into chunks of some CHUNK_BYTES; a chunk holds its documents'
words as codes into its sorted list of distinct word hashes. Everything that
has to meet across the corpus travels as packed arrays, a row for each chunk
and bucket, already summed inside the chunk:

1. Words: chunks send (hash, training count) to the bucket of the hash. A bucket
   stores the unigram table (hashes, counts) and answers each chunk with the
   words' places and counts; the place in the table is the word's number.
2. Pairs: chunks send their distinct (context, word) numbers with training
   counts to the bucket of the context. A context with more than its share of
   the corpus is split by word. A bucket stores the bigram table and answers
   with the corpus counts of the pairs that were sent and, for each context, how
   many of its words occur once, twice, ... and what mass its words have one level
   down.
3. Good-Turing discounts come from the numbers of words and pairs that occur
   once, twice, ... over the whole corpus. With them and the answers a chunk works
   out the backoff weight of its contexts so that P(. | context) sums to exactly
   one; the parts of split contexts, at most two for each bucket, are added up first.
4. With ``order=3`` the same is done once more for triples: the context is the
   pair before the word, a training pair's two word numbers in one 64-bit number;
   what the weight is normalised by is the two-word probability, which the chunk
   sends along. The first word of a text has no pair before it and stays with
   two words.
5. A chunk scores each token by recursion: the discounted gram if it was seen,
   else the context's backoff weight times the probability one level down, which
   ends at the word's own and, for a word not seen in training, at the mass of
   unseen words.

Words are identified by 64-bit hashes. A bucket's group grows with the words or
grams of its range; the number of buckets grows with the tokens.

Defined results: null text is empty and scores its end token alone. A null
doc_id is scored like any other. Repeated rows count each time. Without
training documents every token counts as unseen. An empty table gives no rows.
Other columns are ignored. An order other than 2 or 3 is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.common import mix64, remove, slices, text_buffer, word_hashes, written
from prescient.session import ready

CHUNK_BYTES = 6 << 20
#: Tokens of the corpus for each bucket, about.
BUCKET_TOKENS = 2_000_000
#: Counts up to this are discounted by Good-Turing.
GOOD_TURING = 5
_END = np.uint64(0x8000000000000001)
_START = 0xFFFFFFFF  # the number of the context before a document
_UNSEEN = 0  # the number of words that training has not
_NS = [f"n{r}" for r in range(1, GOOD_TURING + 2)]


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array by byte planes, compressed: small numbers take little."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[c <= GOOD_TURING + 1].astype(np.int64),
                       minlength=GOOD_TURING + 2)[1:GOOD_TURING + 2].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """Factor of each count 0..k + 1 (the last: all larger ones), from how many things
    occur 1..k + 1 times. Where Good-Turing gives no factor between 0 and 1, half a
    count is taken off."""
    k = GOOD_TURING
    out = np.ones(k + 2)
    tail = (k + 1) * n[k] / n[0] if n[0] else 0.0
    for r in range(1, k + 1):
        d = 0.0
        if n[r - 1] and tail < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Words:
    """Unigram level: probability of a word by its count; what the discounts leave
    goes to all unseen words together."""

    def __init__(self, n: int, v: int, counts: list[int]):
        self.n, self.v = n, v
        self.d = discounts(counts)
        r = np.arange(GOOD_TURING + 2)
        taken = sum((1 - self.d[r]) * r * np.array([0, *counts[:-1], 0]))
        self.unseen = taken / n if n and taken else 1.0 / (n + 1)
        self.scale = 1.0 if n and taken else (1.0 - self.unseen)

    def p(self, c: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(c, GOOD_TURING + 1).astype(np.int64)]
        return np.where(c > 0, self.scale * d * c / max(self.n, 1), self.unseen)


# ------------------------------------------------------------------- chunks

_CHUNK = "chunk long, ids binary, has_id binary, train binary, words binary, vocabulary binary, codes binary"


def _chunks(batches):
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def flush():
        ids, has, train, words, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(words + 1) - 1
        tokens = np.empty(hashes.size + words.size, dtype=np.uint64)
        is_end = np.zeros(tokens.size, dtype=bool)
        is_end[ends] = True
        tokens[is_end] = _END
        tokens[~is_end] = hashes
        vocabulary, codes = np.unique(tokens, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()),
             *(pa.array([x], pa.binary()) for x in (
                 _pack(ids), _pack(has), _pack(train), _pack(words.astype(np.uint32)),
                 vocabulary.tobytes(), _pack(codes.astype(np.uint32))))],
            names=["chunk", "ids", "has_id", "train", "words", "vocabulary", "codes"])

    for b in slices(batches):
        raw, offsets = text_buffer(b.column("text"))
        hashes, words = word_hashes(raw, offsets)
        col = b.column("doc_id")
        held.append((np.asarray(col.fill_null(0), dtype=np.int64),
                     np.asarray(col.is_valid()).astype(np.uint8),
                     np.asarray(b.column("train")).astype(np.uint8), words, hashes))
        size += raw.size
        if size >= CHUNK_BYTES:
            yield flush()
            held, size, number = [], 0, number + 1
    if held:
        yield flush()


# ------------------------------------------------------------------- words

def _word_bucket(vocabulary: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so they ascend with the sorted vocabulary."""
    return ((vocabulary >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send_words(buckets: int):
    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                vocabulary = np.frombuffer(r["vocabulary"], dtype=np.uint64)
                codes = _unpack(r["codes"], np.uint32)
                learned = np.repeat(_unpack(r["train"], np.uint8) == 1,
                                    _unpack(r["words"], np.uint32).astype(np.int64) + 1)
                counts = np.bincount(codes[learned], minlength=vocabulary.size).astype(np.uint32)
                cuts = np.searchsorted(_word_bucket(vocabulary, buckets), np.arange(buckets + 1))
                part = [(k, lo, hi) for k, (lo, hi) in
                        enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in part], pa.int64()),
                     pa.array([r["chunk"]] * len(part), pa.int64()),
                     pa.array([vocabulary[lo:hi].tobytes() for _, lo, hi in part], pa.binary()),
                     pa.array([_pack(counts[lo:hi]) for _, lo, hi in part], pa.binary())],
                    names=["bucket", "chunk", "hashes", "counts"])
    return rows


_WORD_TABLE = "bucket long, chunk long, hashes binary, at binary, counts binary, n long, v long, " \
    + ", ".join(f"{n} long" for n in _NS)


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """The bucket's table row (chunk null) and an answer for each chunk."""
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([_unpack(x, np.uint32) for x in pdf["counts"]]),
                       minlength=every.size).astype(np.int64)
    seen = sums > 0
    place = np.cumsum(seen)  # 1 for the first word; _UNSEEN for words not in training
    place = np.where(seen, place, _UNSEEN)
    parts = np.split(at, np.cumsum([x.size for x in hashes])[:-1])
    none = [None] * len(parts)
    first = {"bucket": pdf["bucket"].iloc[:1].tolist(), "chunk": [None],
             "hashes": [every[seen].tobytes()], "at": [None], "counts": [_pack(sums[seen])],
             "n": [int(sums.sum())], "v": [int(seen.sum())]}  # the end of a text is a token and a word too
    first |= {k: [x] for k, x in zip(_NS, _counts_of_counts(sums[seen]), strict=True)}
    rest = {"bucket": pdf["bucket"].tolist(), "chunk": pdf["chunk"].tolist(), "hashes": none,
            "at": [_pack(place[p].astype(np.uint32)) for p in parts],
            "counts": [_pack(sums[p]) for p in parts], "n": none, "v": none}
    rest |= {k: none for k in _NS}
    out = pd.DataFrame({k: [*first[k], *rest[k]] for k in first})
    return out.astype({k: "Int64" for k in ("chunk", "n", "v", *_NS)})


def _word_numbers(first: dict[int, int]):
    """A chunk with its answers, in the order of its vocabulary: word numbers and counts."""
    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        numbers, counts = [], []
        right = right.sort_values("bucket")
        for k, at, c in zip(right["bucket"], right["at"], right["counts"], strict=True):
            at = _unpack(at, np.uint32)
            numbers.append(np.where(at > 0, at + np.uint32(first[k]), np.uint32(_UNSEEN)))
            counts.append(_unpack(c, np.int64))
        return left.assign(numbers=[_pack(np.concatenate(numbers).astype(np.uint32))],
                           counts=[_pack(np.concatenate(counts))])
    return of


# ------------------------------------------------------------------- grams

class Grams:
    """The distinct (context, word) of a chunk at one level of the model, ascending.

    ``at`` are the tokens that have a gram and ``inverse`` their grams. ``lower`` is
    what the level below says of a gram's word: the count of the word for pairs, the
    two-word probability for triples."""

    def __init__(self, r: dict):
        self.words = _unpack(r["words"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.words + 1) - (self.words + 1)
        self.codes = _unpack(r["codes"], np.uint32).astype(np.int64)
        self.numbers, self.counts = _unpack(r["numbers"], np.uint32), _unpack(r["counts"], np.int64)

    def deal(self, buckets: int, often: int) -> None:
        """``parts``: (bucket, its grams by context and word). A context of more than
        ``often`` occurrences is dealt by word too; what follows an unseen one is not sent."""
        own = mix64(self.context)
        h = np.where(self.context_count > often, mix64(own ^ self.word), own)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        bucket[self.context == _UNSEEN] = -1
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.parts = [(k, order[lo:hi]) for k, (lo, hi) in
                      enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]

    def judged(self, answers: pd.DataFrame, d: np.ndarray, split, lower: np.ndarray):
        """(training count, probability) of each gram from the buckets' answers, the
        weights of split contexts and the probabilities ``lower`` one level down."""
        count = np.zeros(self.word.size, dtype=np.int64)
        alpha = np.ones(self.word.size)
        of = {k: x for k, *x in zip(*(answers[c] for c in ("bucket", "counts", "lowers", "singles")),
                                    strict=True)}
        for k, at in self.parts:
            c, b, singles = of[k]
            count[at] = _unpack(c, np.int64)
            h, first, inverse = np.unique(self.context[at], return_index=True, return_inverse=True)
            weight = backoff(self.context_count[at][first], _unpack(singles, np.uint32), d,
                             _unpack(b, np.float64))
            keys, weights = split
            if keys.size:
                place = np.minimum(np.searchsorted(keys, h), keys.size - 1)
                weight = np.where(keys[place] == h, weights[place], weight)
            alpha[at] = weight[inverse]
        n = np.maximum(self.context_count, 1)
        seen = d[np.minimum(count, GOOD_TURING + 1)] * count / n \
            * np.where(alpha < 0, n / (n + 1.0), 1.0)
        return count, np.where(count > 0, seen, np.abs(alpha) * lower)


class Pairs(Grams):
    """A word after the word before it, or after the start of its text."""

    def __init__(self, r: dict, starts: int):
        super().__init__(r)
        word = self.numbers[self.codes].astype(np.uint64)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.first] = _START
        context_count = np.empty(word.size, dtype=np.int64)
        context_count[1:] = self.counts[self.codes[:-1]]
        context_count[self.first] = starts
        self.at = slice(None)
        self.key, at, self.inverse = np.unique((context << np.uint64(32)) | word,
                                               return_index=True, return_inverse=True)
        self.context, self.word = self.key >> np.uint64(32), self.key & np.uint64(0xFFFFFFFF)
        self.context_count = context_count[at]
        self.lower = self.counts[self.codes[at]]


class Triples(Grams):
    """A word after the pair of words before it, where training has that pair."""

    def __init__(self, r: dict, starts: int):
        pairs = Pairs(r, starts)
        self.__dict__.update({k: getattr(pairs, k) for k in ("words", "first", "codes", "numbers", "counts")})
        self.pair_of, self.pair_p = pairs.inverse, _unpack(r["pair_p"], np.float64)
        count = _unpack(r["pair_counts"], np.int64)
        has = np.ones(self.pair_of.size, dtype=bool)
        has[self.first] = False
        has[1:] &= count[self.pair_of[:-1]] > 0
        self.at = np.flatnonzero(has)
        before, own = self.pair_of[self.at - 1], self.pair_of[self.at]
        key, at, self.inverse = np.unique(
            (before.astype(np.uint64) << np.uint64(32)) | pairs.word[own],
            return_index=True, return_inverse=True)
        self.word = key & np.uint64(0xFFFFFFFF)
        self.context, self.context_count = pairs.key[before[at]], count[before[at]]
        self.lower = self.pair_p[own[at]]


#: By level: the grams of a chunk and the kind of their ``lower``.
_LEVELS = {2: (Pairs, np.int64), 3: (Triples, np.float64)}
_SENT = "bucket long, chunk long, context binary, word binary, lower binary, " \
    "context_count binary, counts binary"


def _send_grams(level: int, buckets: int, often: int, starts: int):
    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                p = _LEVELS[level][0](r, starts)
                p.deal(buckets, often)
                learned = np.repeat(_unpack(r["train"], np.uint8) == 1, p.words + 1)[p.at]
                counts = np.bincount(p.inverse[learned], minlength=p.word.size).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in p.parts], pa.int64()),
                     pa.array([r["chunk"]] * len(p.parts), pa.int64()),
                     *(pa.array([_pack(f(x)) for _, x in p.parts], pa.binary()) for f in (
                         lambda x: np.diff(p.context[x], prepend=np.uint64(0)),
                         lambda x: p.word[x].astype(np.uint32),
                         lambda x: p.lower[x], lambda x: p.context_count[x],
                         lambda x: counts[x]))],
                    names=["bucket", "chunk", "context", "word", "lower", "context_count",
                           "counts"])
    return rows


_GRAM_TABLE = "bucket long, chunk long, contexts binary, words binary, counts binary, " \
    "lowers binary, singles binary, split binary, split_n binary, split_lowers binary, " \
    "split_singles binary, " + ", ".join(f"{n} long" for n in _NS)


def _count_grams(level: int, words: Words, often: int):
    """The bucket's table row (chunk null) and an answer for each chunk: the corpus
    counts of its grams and, by context, what the backoff weight is made of: the mass
    of the seen words one level down (``lowers``) and the numbers of words that occur
    1..GOOD_TURING times (``singles``)."""
    kind = _LEVELS[level][1]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = [np.cumsum(_unpack(h, np.uint64), dtype=np.uint64) for h in pdf["context"]]
        context = np.concatenate(contexts)
        code = context if level == 2 else \
            np.unique(context, return_inverse=True)[1].astype(np.uint64)
        word = np.concatenate([_unpack(w, np.uint32) for w in pdf["word"]])
        every, first, at = np.unique((code << np.uint64(32)) | word,
                                     return_index=True, return_inverse=True)
        del code
        sums = np.bincount(at, weights=np.concatenate([_unpack(x, np.uint32) for x in pdf["counts"]]),
                           minlength=every.size).astype(np.int64)
        lower = np.concatenate([_unpack(x, kind) for x in pdf["lower"]])[first]
        lower = np.where(sums > 0, words.p(lower) if level == 2 else lower, 0.0)
        context, word = context[first], word[first]
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        h, b = context[start], np.add.reduceat(lower, start)
        n = np.concatenate([_unpack(x, np.int64) for x in pdf["context_count"]])[first[start]]
        singles = np.stack([np.add.reduceat(sums == r, start, dtype=np.uint32)
                            for r in range(1, GOOD_TURING + 1)])
        s = n > often
        parts = np.split(at, np.cumsum([x.size for x in contexts])[:-1])
        places = [np.searchsorted(h, np.unique(x)) for x in contexts]
        none = [None] * len(parts)
        # Contexts stay in the table even if all their grams are unseen: they back off too.
        head = {"bucket": pdf["bucket"].iloc[:1].tolist(), "chunk": [None],
                "contexts": [_pack(np.diff(context, prepend=np.uint64(0)))],
                "words": [_pack(word)], "counts": [_pack(sums)], "lowers": [_pack(b)],
                "singles": [_pack(singles.ravel())], "split": [h[s].tobytes()],
                "split_n": [n[s].tobytes()], "split_lowers": [b[s].tobytes()],
                "split_singles": [singles[:, s].tobytes()]}
        head |= {k: [x] for k, x in zip(_NS, _counts_of_counts(sums), strict=True)}
        rest = dict.fromkeys(head, none) | {
            "bucket": pdf["bucket"].tolist(), "chunk": pdf["chunk"].tolist(),
            "counts": [_pack(sums[p]) for p in parts], "lowers": [_pack(b[p]) for p in places],
            "singles": [_pack(singles[:, p].ravel()) for p in places]}
        out = pd.DataFrame({k: [*head[k], *rest[k]] for k in head})
        return out.astype({k: "Int64" for k in ("chunk", *_NS)})
    return of


def backoff(n: np.ndarray, singles: np.ndarray, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weight of the level below after a context seen ``n`` times: what discounting
    takes from the ``singles`` (1..GOOD_TURING times, each for all contexts) over the
    mass ``b`` lower down leaves to unseen words. Negative: no count was discounted, so
    the grams are scaled by n / (n + 1) to leave some mass."""
    r = np.arange(1, GOOD_TURING + 1)
    left = ((1 - d[r]) * r) @ singles.reshape(GOOD_TURING, -1) / np.maximum(n, 1)
    none = left < 1e-9
    alpha = np.where(none, 1.0 / (n + 1.0), left) / np.maximum(1.0 - b, 1e-12)
    return np.where(n > 0, np.where(none, -alpha, alpha), 1.0)


def _split_weights(rows, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts ascending, their weights) of those that are split by word, from the
    buckets' parts."""
    if not rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    h, place = np.unique(np.concatenate([np.frombuffer(r.split, np.uint64) for r in rows]),
                         return_inverse=True)
    n = np.zeros(h.size)
    n[place] = np.concatenate([np.frombuffer(r.split_n, np.int64) for r in rows])
    b = np.bincount(place, minlength=h.size, weights=np.concatenate(
        [np.frombuffer(r.split_lowers) for r in rows]))
    parts = np.concatenate([np.frombuffer(r.split_singles, np.uint32).reshape(GOOD_TURING, -1)
                            for r in rows], axis=1)
    singles = np.stack([np.bincount(place, weights=x, minlength=h.size) for x in parts])
    return h, backoff(n, singles, d, b)


# ------------------------------------------------------------------- scores

_KNOWN = "chunk long, ids binary, has_id binary, train binary, words binary, codes binary, " \
    "numbers binary, counts binary"
_SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _pair_state(words: Words, d, split, buckets, often, starts):
    """The chunk with the counts and probabilities of its pairs."""
    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in (*left.columns, "pair_p", "pair_counts")})
        p = Pairs(left.iloc[0], starts)
        p.deal(buckets, often)
        count, prob = p.judged(right, d, split.value, words.p(p.lower))
        return left.assign(pair_p=[_pack(prob)], pair_counts=[_pack(count)])
    return of


def _score(level: int, words: Words, d, split, buckets, often, starts):
    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in _SCORE.split(", ")})
        r = left.iloc[0]
        p = _LEVELS[level][0](r, starts)
        p.deal(buckets, often)
        _, prob = p.judged(right, d, split.value, words.p(p.lower) if level == 2 else p.lower)
        if level == 2:
            logs = np.log10(prob)[p.inverse]
        else:
            logs = np.log10(p.pair_p)[p.pair_of]
            logs[p.at] = np.log10(prob)[p.inverse]
        c = p.counts[p.codes]
        base = np.log10((c + 1.0) / (words.n + words.v + 1.0))
        has = _unpack(r["has_id"], np.uint8) == 1
        ids = pd.array(_unpack(r["ids"], np.int64), dtype="Int64")
        ids[~has] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "train": _unpack(r["train"], np.uint8) == 1, "n_tokens": p.words + 1,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), p.first),
            "base_score": np.add.reduceat(base, p.first),
            "score": np.add.reduceat(logs, p.first)})
    return of


class Model:
    """The tables of each level in the shared folder, the numbers over all words and
    the discounts of each level above them."""

    def __init__(self, words: Words, unigrams: DataFrame):
        self.words, self.unigrams = words, unigrams
        self.d: dict[int, np.ndarray] = {}
        self.grams: dict[int, DataFrame] = {}


def score(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS, order: int = 2) -> tuple[DataFrame, Model]:
    """Learn from the rows of ``docs`` (doc_id, text, train) marked train and score all:
    doc_id, train, n_tokens, n_known, base_score, score (log10). ``order`` words: 2 or 3."""
    if order not in _LEVELS:
        raise ValueError(f"order {order}: 2 or 3")
    spark = docs.sparkSession
    ready(spark)
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                 F.coalesce("train", F.lit(False)).alias("train"))
                     .mapInArrow(_chunks, _CHUNK), "lm-chunks")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"),
                    F.count(F.when(F.col("train"), 1)).alias("train")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, int((size.b or 0) / 6 + size.n) // bucket_tokens + 1)
    dealt = {"bucket": buckets, "chunk": (size.b or 0) // CHUNK_BYTES + 1}
    starts = size.train

    def by(df: DataFrame, key: str):
        """Groups over as many tasks as there are buckets or chunks, if that is more than
        the session's, so that a task's share does not grow with the corpus."""
        return (df.repartition(dealt[key], key) if dealt[key] > tasks else df).groupBy(key)

    counted = written(by(chunks.select("chunk", "words", "train", "vocabulary", "codes")
                         .mapInArrow(_send_words(buckets),
                                     "bucket long, chunk long, hashes binary, counts binary"),
                         "bucket").applyInPandas(_count_words, _WORD_TABLE), "lm-words")
    unigrams = counted.where("chunk is null").select("bucket", "hashes", "counts", "n", "v", *_NS)
    by_bucket = {r.bucket: r for r in unigrams.select("bucket", "n", "v", *_NS).collect()}
    first, total = {}, 0  # a number for each bucket
    for k in sorted(by_bucket):
        first[k] = total
        total += by_bucket[k].v
    if total >= _START:
        raise ValueError("over 2^32 - 2 distinct words")
    words = Words(sum(r.n for r in by_bucket.values()), total,
                  [sum(r[k] for r in by_bucket.values()) for k in _NS])
    known = written(by(chunks.select("chunk", "ids", "has_id", "train", "words", "codes"), "chunk")
                    .cogroup(by(counted.where("chunk is not null")
                                .select("chunk", "bucket", "at", "counts"), "chunk"))
                    .applyInPandas(_word_numbers(first), _KNOWN), "lm-known")
    remove(spark, chunks)
    model = Model(words, unigrams)
    often = max(words.n // (2 * buckets), 1)

    def learn(known: DataFrame, level: int):
        """Count the grams of a level: the answers to each chunk, the discounts and the
        weights of split contexts."""
        inner = [c for c in known.columns if c not in ("ids", "has_id")]
        counted = written(by(known.select(*inner)
                             .mapInArrow(_send_grams(level, buckets, often, starts), _SENT),
                             "bucket").applyInPandas(_count_grams(level, words, often), _GRAM_TABLE),
                          f"lm-grams-{level}")
        table = counted.where("chunk is null")
        sums = table.agg(*(F.sum(n).alias(n) for n in _NS)).first()
        d = discounts([sums[n] or 0 for n in _NS])
        split = _split_weights(table.where(F.length("split") > 0).select(
            "split", "split_n", "split_lowers", "split_singles").collect(), d)
        model.d[level], model.grams[level] = d, table
        answers = counted.where("chunk is not null").select(
            "chunk", "bucket", "counts", "lowers", "singles")
        return answers, d, spark.sparkContext.broadcast(split)

    answers, *weights = learn(known, 2)
    if order == 3:
        pairs = written(by(known, "chunk").cogroup(by(answers, "chunk")).applyInPandas(
            _pair_state(words, *weights, buckets, often, starts),
            f"{_KNOWN}, pair_p binary, pair_counts binary"), "lm-pair-state")
        remove(spark, known)
        known = pairs
        answers, *weights = learn(known, 3)
    scores = by(known, "chunk").cogroup(by(answers, "chunk")).applyInPandas(
        _score(order, words, *weights, buckets, often, starts), _SCORE)
    return scores, model
