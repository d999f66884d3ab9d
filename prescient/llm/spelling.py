"""Spelling variants by permuterm rotations.

Words that differ by one inserted, deleted or replaced code point are near. Each word
gets a terminator and all its rotations: for every place i the text after i, the
terminator and the text before i. Skipping the code point at i, the rotations of words
that differ there alone are one prefix range; the same prefix is a whole rotation of
the word without that code point. So the rotations are sorted by that prefix over
ranges, tasks scan the groups, and every near pair meets in exactly one group:
replacements where the differing place is skipped, insertions and deletions at the
first of a run of equal code points.

A group has at most one whole rotation and, as its skipped code points differ, at
most one word more than the alphabet has letters. A scan emits for each member its
number of neighbours and the best of them, not the pairs, so rows grow with the
rotations only. A rotation of over PLAIN code points is replaced by two polynomial
hashes (modulo 2^61 - 1) of its two parts with their lengths, so a long word costs rows
in proportion to its length, not to its square.

The form of a word is its near word of largest count (ties: smallest in code-point
order) if that count is at least RATIO times the word's own; forms are followed to the
last by doubling, at most log2 of log(count) to RATIO rounds, as counts grow by RATIO.

Defined results: null, empty and letterless texts hold no words. Repeated rows count
each time. An empty table gives no rows. Texts of any length are cut between words
and counted part by part. Words under LEAST_LETTERS or LEAST_COUNT are not compared.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.common import written
from prescient.session import ready

# Fixed value: the letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Code points of a rotation that is compared as text.
PLAIN = 64
#: Code points of a text that are counted at a time.
PART = 1 << 20
#: Distinct words that a task holds before it sends their counts on.
HELD = 200_000
#: Sorts before every letter.
END = "\x01"

_LOWER = {i: i + 32 for i in range(65, 91)}
_MODULUS = (1 << 61) - 1
_BASES = (1_000_003, 998_244_353)


# ------------------------------------------------------------------- the words

def _parts(text: str, part: int):
    """``text`` in parts of about ``part`` code points that end between words."""
    letter = re.compile(LETTERS)
    at = 0
    while at < len(text):
        end = min(len(text), at + part)
        inside = letter.match(text, end) if end < len(text) else None
        end = inside.end() if inside else end
        yield text[at:end]
        at = end


def _count(alter, least: int, part: int):
    """Texts to counts of their words of at least ``least`` code points."""
    find = re.compile(LETTERS).findall

    def rows(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                              pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            ids = b.column("id").to_pylist()
            for i, text in enumerate(b.column("text")):
                for piece in _parts(text.as_py() or "", part):
                    for w, n in Counter(find(piece)).items():
                        if len(w) >= least:
                            w = w.lower() if w.isascii() else w.translate(_LOWER)
                            w = alter(ids[i], w) if alter else w
                            if len(w) >= least:
                                held[w] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()
    return rows


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", alter=None, least: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT, part: int = PART) -> DataFrame:
    """(word, n) of ``docs`` (text): words in lower case (A-Z only) of at least ``least``
    code points that occur ``least_count`` times or more, written. ``alter``: a function
    of a row's id as text and a word, which gives the word that counts instead."""
    ready(docs.sparkSession)
    return written(
        docs.select(F.col(doc_id).cast("string").alias("id"), "text")
        .mapInArrow(_count(alter, least, part), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")


# --------------------------------------------------------------- the rotations

def _hashes(word: str, base: int) -> tuple[list[int], list[int]]:
    """Hashes of the prefixes of ``word`` and powers of ``base``."""
    h, p = [0], [1]
    for c in word:
        h.append((h[-1] * base + ord(c)) % _MODULUS)
        p.append(p[-1] * base % _MODULUS)
    return h, p


def rotations(word: str, plain: int = PLAIN) -> list[tuple[str, int]]:
    """(key, kind) of the rotations of ``word``. Kind 0: the whole rotation, kind 1:
    one code point is skipped, 2: as 1, and the code point differs from the one before
    (so leaving it out gives a word not met at an earlier place)."""
    size = len(word)

    def kind(i):
        return 1 if i and word[i] == word[i - 1] else 2

    out = []
    long = [_hashes(word, b) for b in _BASES] if size > plain else None

    def key(i, j):  # the text from j on, the end, the text before i
        if j - i + plain >= size:
            return word[j:] + END + word[:i]
        parts = [f"{(h[size] - h[j] * p[size - j]) % _MODULUS:x}.{h[i]:x}" for h, p in long]
        return f"{END}{size - j}.{i}.{'.'.join(parts)}"

    for i in range(size):
        out.append((key(i, i + 1), kind(i)))
    for i in range(size + 1):
        out.append((key(i, i), 0))
    return out


def _rotate(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            piece = b.slice(lo, 256)
            keys, kinds, at = [], [], []
            for i, w in enumerate(piece.column("word").to_pylist()):
                for k, kind in rotations(w):
                    keys.append(k)
                    kinds.append(kind)
                    at.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(kinds, pa.int8()),
                 piece.column("word").take(pa.array(at)), piece.column("n").take(pa.array(at))],
                names=["key", "kind", "word", "n"])


def _scan(batches):
    """Sorted rotations to (word, number of neighbours, best neighbour and its count)
    for every member of a group that has a neighbour in it."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        ends = np.flatnonzero(np.asarray(pc.not_equal(t["key"][1:], t["key"][:-1]))) + 1
        # The last group may go on in the next batch.
        cut = int(ends[-1]) if ends.size else 0
        held = t.slice(cut)
        if cut:
            yield _best(t.slice(0, cut), np.concatenate([[0], ends]))
    if held is not None and held.num_rows:
        yield _best(held, np.array([0, held.num_rows]))


def _best(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    size = np.diff(bounds)
    rows = np.flatnonzero(np.repeat(size > 1, size))
    few = t.take(pa.array(rows))
    group = np.repeat(np.arange(size.size), size)[rows]
    word, kind = few["word"].to_pylist(), few["kind"].to_numpy()
    n = few["n"].to_pylist()
    out: dict[str, list] = {"word": [], "near": [], "best": [], "best_n": []}

    def emit(i, others):
        if others:
            j = min(others, key=lambda x: (-n[x], word[x]))
            for k, v in zip(out, (word[i], len(others), word[j], n[j]), strict=True):
                out[k].append(v)

    for members in np.split(np.arange(rows.size), np.flatnonzero(np.diff(group)) + 1):
        members = members.tolist()
        skipped = [i for i in members if kind[i]]
        whole = [i for i in members if not kind[i]]
        shorter = {i: whole if kind[i] == 2 else [] for i in skipped}
        for i in skipped:  # at most one for each letter
            emit(i, [j for j in skipped if j != i] + shorter[i])
        for i in whole:
            emit(i, [j for j in skipped if kind[j] == 2])
    return pa.RecordBatch.from_arrays(
        [pa.array(out["word"], pa.string()), pa.array(out["near"], pa.int64()),
         pa.array(out["best"], pa.string()), pa.array(out["best_n"], pa.int64())],
        names=list(out))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row for each row of ``words`` (word, n; words distinct): word, n, n_near,
    form, form_n and root."""
    spark = words.sparkSession
    ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turned = written(words.select("word", "n").mapInArrow(
        _rotate, "key string, kind byte, word string, n long"), "rotations")
    best = turned.repartitionByRange(parts, "key").sortWithinPartitions("key") \
        .mapInArrow(_scan, "word string, near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("first")
    near = best.groupBy("word").agg(F.sum("near").alias("n_near"), first)
    known = written(words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.expr(f"if(-first.minus >= {int(ratio)} * n, first.best, null)").alias("form"),
        F.expr(f"if(-first.minus >= {int(ratio)} * n, -first.minus, null)").alias("form_n")),
        "variants")
    roots = written(known.where("form is not null").select("word", F.col("form").alias("root")),
                    "roots")
    while True:
        step = roots.toDF("root", "next")
        further = written(roots.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
