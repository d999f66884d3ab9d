"""Language identification by mixture inference over n-gram likelihoods.

Training counts byte trigrams (letters in lower case, other ASCII as a space)
for each language, hashed to a fixed number of slots. A document is a mixture
of languages and a uniform background, which stands for text in none of them:
expectation-maximisation estimates the share of each that makes its trigrams
likeliest. The predicted language is the likeliest learned one. A document is marked
rejected if the learned shares together are below LEAST_LEARNED, so one of several
learned languages is not. Languages beyond the first are kept only if they raise the log-likelihood by more than a penalty for
each, so the set of a document's languages follows from the penalised likelihood.

The counts of a task are one array for each language; they are summed in two
rounds of groups keyed by language and slot range, so no group grows with the
corpus by more than the number of tasks over SALTS. The model that is broadcast
has languages x SLOTS numbers, languages being at most MOST_LANGUAGES; more of them make
the slices of text smaller. A task sends its counts on whenever it holds FLUSH.

Defined results: ``und`` with score 0 for null text and text without a letter, or if
no language was learned; any other text has a learned language. Rejected is ``und``,
text that the learned languages do not explain, and text with letters below
LEAST_LETTERS of its bytes that are not white space. Rows with null language are not
learned from.
Repeated rows count each time. An empty table gives no rows. Very long texts
are one document each. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prescient.llm.common import SLICE_BYTES, slices, text_buffer
from prescient.session import ready

SLOTS = 1 << 16
#: Languages that a model may hold, from memory: what is broadcast has 0.27 GB then.
MOST_LANGUAGES = 1024
#: Languages whose counts a training task holds at a time (0.5 MB each).
FLUSH = 64
#: Added to each count.
SMOOTHING = 0.1
#: Rounds of expectation-maximisation.
ROUNDS = 10
#: Shares below this are not tried in a document's set of languages.
LEAST_SHARE = 0.02
#: Log-likelihood that each further language must add, per log of the trigrams.
PENALTY = 2.0
#: Share of the learned languages together below which a document is rejected.
LEAST_LEARNED = 0.6
#: Share of letters (other scripts: bytes) in what is not white space below which a
#: document is rejected.
LEAST_LETTERS = 0.2
UNKNOWN = "und"

# Working columns of ``predict``.
_TEXT, _LETTER = "_langid_text", "_langid_letter"
_RANGES = 16
_SALTS = 256

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the distinct hashed trigrams of each text, rows ascending."""
    padded = pc.binary_join_element_wise(" ", col.fill_null(""), " ", "")
    raw, offsets = text_buffer(padded)
    b = _FOLD[raw].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    row = np.repeat(np.arange(len(col), dtype=np.uint64), np.diff(offsets))[:-2]
    ok = code != 0x202020
    ends = offsets[1:] - 1  # no trigram starts at the last two bytes of a row
    ok[ends[ends < ok.size]] = False
    ok[(ends - 1)[ends - 1 < ok.size]] = False
    slot = (code[ok] * np.uint32(2654435761)) >> np.uint32(16)
    key = (row[ok] << np.uint64(16)) | slot
    if len(col) < 1 << 16:
        key = key.astype(np.uint32)
    key.sort()
    if not key.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(new, append=key.size)
    key = key[new].astype(np.int64)
    return key >> 16, key & 0xFFFF, count


# ------------------------------------------------------------------- training

def _count(batches):
    from pyspark import TaskContext
    salt = TaskContext.get().partitionId() % _SALTS
    width = SLOTS // _RANGES
    sums: dict[str, np.ndarray] = {}

    def flush():
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * _RANGES), pa.array(range(_RANGES), pa.int32()),
                 pa.array([salt] * _RANGES, pa.int32()),
                 pa.array([zlib.compress(counts[i * width:(i + 1) * width].tobytes(), 1)
                           for i in range(_RANGES)], pa.binary())],
                names=["lang", "range", "salt", "counts"])
        sums.clear()

    for b in slices(batches):
        langs = b.column("lang").to_pylist()
        row, slot, n = trigrams(b.column("text"))
        names, at = np.unique(np.array(langs, dtype=object), return_inverse=True)
        order = np.argsort(at[row], kind="stable")
        ends = np.searchsorted(at[row][order], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            if name not in sums and len(sums) >= FLUSH:
                yield from flush()
            mine = order[ends[i]:ends[i + 1]]
            part = np.bincount(slot[mine], weights=n[mine], minlength=SLOTS).astype(np.int64)
            sums[name] = sums[name] + part if name in sums else part
    yield from flush()


def _numbers(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), dtype=np.int64)


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLOTS // _RANGES, dtype=np.int64)
    for c in pdf["counts"]:
        total += _numbers(c)
    out = pdf.iloc[:1].copy()
    out["counts"] = [zlib.compress(total.tobytes(), 1)]
    return out


class Model:
    """Languages in order and the likelihood of each slot in each of them and, in
    the last column, in the background."""

    def __init__(self, languages: list[str], counts):
        """``counts``: the counts of each language's slots, in order."""
        self.languages = languages
        self.p = np.full((SLOTS, len(languages) + 1), 1 / SLOTS, dtype=np.float32)
        for i, c in enumerate(counts):
            p = c.astype(np.float64) + SMOOTHING
            self.p[:, i] = p / p.sum()


def train(docs: DataFrame) -> Model:
    """Learn from ``docs`` (text, lang); all rows with a language and a text."""
    ready(docs.sparkSession)
    found = docs.where("lang is not null and text is not null") \
        .select("text", F.col("lang").cast("string").alias("lang"))
    schema = "lang string, range int, salt int, counts binary"
    sums = found.mapInArrow(_count, schema) \
        .groupBy("lang", "range", "salt").applyInPandas(_sum, schema) \
        .groupBy("lang", "range").applyInPandas(_sum, schema)
    parts = {(r.lang, r.range): r.counts for r in sums.collect()}
    languages = sorted({k for k, _ in parts})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    return Model(languages, (np.concatenate([_numbers(parts[k, i]) for i in range(_RANGES)])
                             for k in languages))


# ------------------------------------------------------------------ inference

def _em(p: np.ndarray, n: np.ndarray, first: np.ndarray, row: np.ndarray,
        share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) of each document after ``rounds``; zero shares stay."""
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        q = p * share[row]
        q *= (n / q.sum(axis=1))[:, None]
        share = (np.add.reduceat(q, first, axis=0) / total[:, None]).astype(np.float32)
    likely = np.log(np.maximum((p * share[row]).sum(axis=1), 1e-30)) * n
    return share, np.add.reduceat(likely.astype(np.float64), first)


def infer(model: Model, row: np.ndarray, slot: np.ndarray, n: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shares over all languages, shares over the chosen set) for the
    documents that have trigrams; the last share is the background's."""
    k = len(model.languages)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    docs = row[first]
    at = np.repeat(np.arange(docs.size), np.diff(first, append=row.size))
    p, n = model.p[slot], n.astype(np.float32)
    start = np.full((docs.size, k + 1), 0.5 / k, dtype=np.float32)
    start[:, k] = 0.5
    full, _ = _em(p, n, first, at, start, ROUNDS)
    order = np.argsort(-full[:, :k], axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    rank = np.hstack([rank, np.full((docs.size, 1), -1)])  # the background is in every set
    chosen = full * (rank <= 0)
    # Mixed documents: try sets of the 2, 3, ... likeliest languages.
    large = full >= LEAST_SHARE
    large[:, k] = False
    many = np.flatnonzero(large.sum(axis=1) > 1)
    if many.size:
        sub = np.isin(at, many)
        row2 = np.searchsorted(many, at[sub])
        first2 = np.flatnonzero(np.concatenate([[True], row2[1:] != row2[:-1]]))
        p2, n2 = p[sub], n[sub]
        penalty = PENALTY * np.log(np.maximum(np.add.reduceat(n2, first2), 2.0))
        best = np.full(many.size, -np.inf)
        for size in range(1, int(large[many].sum(axis=1).max()) + 1):
            inside = (rank[many] < size) & (large[many] | (rank[many] <= 0))
            # The background starts anew: what other languages held may be its.
            share = full[many] * inside
            share[:, k] = np.maximum(share[:, k], LEAST_SHARE)
            share /= share.sum(axis=1, keepdims=True)
            share, likely = _em(p2, n2, first2, row2, share, ROUNDS)
            likely -= penalty * inside[:, :k].sum(axis=1)
            better = likely > best
            best[better] = likely[better]
            chosen[many[better]] = share[better]
    return docs, full, chosen


def _few_letters(text: pa.Array) -> np.ndarray:
    """Whether letters are below LEAST_LETTERS of a text's bytes without white space."""
    raw, offsets = text_buffer(text)

    def per_text(marked):
        upto = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return upto[offsets[1:]] - upto[offsets[:-1]]
    return per_text(_FOLD[raw] != 32) < LEAST_LETTERS * per_text(raw > 32)


def _sets(languages: list[str], shares: np.ndarray) -> pa.Array:
    """Each row's languages of some share, the largest share first."""
    row, lang = np.nonzero(shares)
    share = np.clip(shares[row, lang], 0.0, 1.0)
    order = np.lexsort((lang, -share, row))
    ends = np.concatenate([[0], np.cumsum((shares != 0).sum(axis=1))])
    items = pa.StructArray.from_arrays(
        [pa.array([languages[i] for i in lang[order]], pa.string()), pa.array(share[order])],
        names=["lang", "share"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _predict(model):
    def rows(batches):
        m = model.value
        for b in slices(batches, _TEXT, SLICE_BYTES // 2 // max(1, len(m.languages) // 16)):
            size = b.num_rows
            pred = np.full(size, -1)
            score = np.zeros(size)
            shares = np.zeros((size, len(m.languages)))
            rejected = np.ones(size, dtype=bool)
            if m.languages:
                row, slot, n = trigrams(b.column(_TEXT))
                if row.size:
                    docs, full, chosen = infer(m, row, slot, n)
                    top = chosen[:, :-1].argmax(axis=1)
                    pred[docs] = top
                    rejected[docs] = full[:, :-1].sum(axis=1) < LEAST_LEARNED
                    score[docs] = full[np.arange(docs.size), top]
                    shares[docs] = chosen[:, :-1]
            pred[~np.asarray(b.column(_LETTER).fill_null(False))] = -1
            rejected |= _few_letters(b.column(_TEXT)) | (pred < 0)
            score[pred < 0] = 0
            shares[pred < 0] = 0
            names = [*m.languages, UNKNOWN]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names if c not in (_TEXT, _LETTER)),
                 pa.array([names[i] for i in pred], pa.string()),
                 pa.array(np.clip(score, 0.0, 1.0)), _sets(m.languages, shares),
                 pa.array(rejected)],
                names=[*(c for c in b.schema.names if c not in (_TEXT, _LETTER)),
                       "lang_pred", "score", "languages", "rejected"])
    return rows


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The ``keep`` columns of ``docs`` (text) with lang_pred, score, the estimated
    share of that language in the text, languages, the chosen set with the share of
    each (what is left is the background's; empty if ``und``), and rejected."""
    spark = docs.sparkSession
    kept = docs.select(*keep)
    sent = spark.sparkContext.broadcast(model)
    return docs.select(*keep, F.col("text").alias(_TEXT),
                       F.col("text").rlike(r"\p{L}").alias(_LETTER)) \
        .mapInArrow(_predict(sent), T.StructType(
            [*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
             T.StructField("score", T.DoubleType()),
             T.StructField("languages", T.ArrayType(T.StructType(
                 [T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
             T.StructField("rejected", T.BooleanType())]))
