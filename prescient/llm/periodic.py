"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(LEAST_WORDS, 2 q) words that no neighbouring word
extends. The dictionary names the factors of each power-of-two length m: equal
names, equal words, the name of a factor of length 2 m being that of the pair of
names of its halves. Positions whose factor occurs nowhere else in their text are
left out of the longer lengths, as no run begins a repetition there.

For periods 2 m <= q < 4 m, a run holds a position i that is a multiple of m, and
the factor of length m at i occurs again q words later inside the run. So the
successor occurrences of the factors at these positions, 2 m to 4 m - 1 words on,
propose every period (q = 1 comes from neighbours that are equal). Occurrences at
most m / 2 apart form an arithmetic progression whose difference is the factor's
own period; a position proposes none of its own progression, since a stretch of
that kind has the smaller period. Proposals of one period that touch are one. Each
is extended both ways by names, and of stretches with one beginning and end the
smallest period stays.

A task works on slices of texts, all arrays being of the slice's words; a very long
text is a slice of its own and takes some 100 bytes a word.

Defined results: null, empty and blank texts have no run and collapse to the empty
text. Every row has its own result, so repeated rows and null ids need no rule. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prescient.llm.common import slices, text_buffer, word_spans
from prescient.session import ready

#: Words of a run, at least.
LEAST_WORDS = 12
#: Power of two of the longest names that are kept for extending.
TOP = 8

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in
                                 ("start", "length", "period")]))
_TEXT = "_periodic_text"


# -------------------------------------------------------------------- the runs

def _named(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names from 1, 0 where the key occurs once in its row; order by name and place)."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(k.size, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    alone = new.copy()
    alone[:-1] &= new[1:]
    name = np.cumsum(new & ~alone)
    name[alone] = 0
    out = np.empty(k.size, dtype=np.int64)
    out[order] = name
    return out, order[~alone]


def _proposals(pos: np.ndarray, name: np.ndarray, first: np.ndarray, m: int):
    """(position, period) pairs that the occurrences ``pos`` of factors of length m
    propose; ordered by name, then place. ``first``: where each one's text begins."""
    n = pos.size
    far = np.ones(n, dtype=bool)  # begins a progression
    far[1:] = (name[1:] != name[:-1]) | (2 * (pos[1:] - pos[:-1]) > m)
    begins = np.flatnonzero(far)
    after = np.append(begins[1:], n)[np.cumsum(far) - 1]  # end of own progression
    ask = np.flatnonzero((pos - first) % m == 0)
    width = int(pos.max()) + 4 * m + 1
    key = name * width + pos
    base = name[ask] * width + pos[ask]
    lo = np.maximum(np.searchsorted(key, base + 2 * m), after[ask])
    count = np.searchsorted(key, base + 4 * m) - lo
    some = count > 0
    ask, lo, count = ask[some], lo[some], count[some]
    for at in _blocks(count):
        c = count[at]
        back = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        i = np.repeat(pos[ask[at]], c)
        yield i, pos[np.repeat(lo[at], c) + back] - i


def _blocks(count: np.ndarray, limit: int = 1 << 20):
    """Slices of ``count`` with sums of about ``limit``."""
    upto = np.cumsum(count)
    at = 0
    while at < count.size:
        to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")), at + 1)
        yield slice(at, to)
        at = to


def _touching(i: np.ndarray, q: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One proposal of those of one period that are at most m apart."""
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    new = np.ones(i.size, dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] > m)
    return i[new], q[new]


def _extend(a: np.ndarray, b: np.ndarray, names: list[np.ndarray], first: np.ndarray,
            ahead: bool) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on, or before them, inside the text
    that begins at ``first`` (names of factors across two texts are 0)."""
    out = np.zeros(a.size, dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        step, name = 1 << k, names[k]
        todo = np.arange(a.size)
        while todo.size:
            x, y = a[todo], b[todo]
            if ahead:
                x, y = x + out[todo], y + out[todo]
                same = (name[x] == name[y]) & (name[x] > 0)
            else:
                x, y = x - out[todo] - step, y - out[todo] - step
                inside = x >= first[todo]
                x, y = np.where(inside, x, 0), np.where(inside, y, 0)
                same = inside & (name[x] == name[y]) & (name[x] > 0)
            todo = todo[same]
            out[todo] += step
            if k < len(names) - 1:
                break
    return out


def find_runs(words: np.ndarray, per_row: np.ndarray, least: int = LEAST_WORDS
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of every run, by row, start and period. ``words``:
    numbers of the words of all rows, one row after the other."""
    n = words.size
    ends = np.cumsum(per_row)
    row = np.repeat(np.arange(per_row.size), per_row)
    first = np.repeat(ends - per_row, per_row)
    name, order = _named(words.astype(np.int64), row)
    names, found = [], []
    equal = (name[1:] == name[:-1]) & (name[1:] > 0)
    new = np.flatnonzero(equal & ~np.concatenate([[False], equal[:-1]])) if n > 1 else \
        np.zeros(0, dtype=np.int64)
    found.append((new, np.ones(new.size, dtype=np.int64)))
    m = 1
    while True:
        full = np.zeros(n + 1, dtype=np.int32)
        full[:n] = name
        if m <= 1 << TOP:
            names.append(full)
        if not order.size:
            break
        parts = list(_proposals(order, name[order], first[order], m))
        if parts:
            found.append(_touching(*(np.concatenate(x) for x in zip(*parts, strict=True)), m))
        # Names of twice the length, where both halves occur elsewhere in the text.
        at = np.sort(order)
        at = at[at + m < n]
        at = at[(full[at + m] > 0) & (row[at + m] == row[at])]
        key = full[at].astype(np.int64) * (n + 1) + full[at + m]
        part, sub = _named(key, row[at])
        name = np.zeros(n, dtype=np.int64)
        name[at] = part
        order = at[sub]
        m *= 2
    i = np.concatenate([x for x, _ in found])
    q = np.concatenate([x for _, x in found])
    begin = first[i] if i.size else i
    start = i - _extend(i, i + q, names, begin, ahead=False)
    end = i + q + _extend(i, i + q, names, begin, ahead=True)
    good = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[good], end[good], q[good]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(start.size, dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    return row[start], start - first[start], end - start, q


def dropped(n: int, begin: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words a run that begins at ``begin`` holds after its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, begin + period, 1)
    np.add.at(step, begin + length, -1)
    return np.cumsum(step[:n]) > 0


# ------------------------------------------------------------------ the tables

def _word_table(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words as binary values, words per row)."""
    raw, offsets = text_buffer(col)
    start, end, per_row = word_spans(raw, offsets)
    if not start.size:
        return pa.array([], pa.large_binary()), per_row
    cuts = np.empty(2 * start.size, dtype=np.int64)
    cuts[0::2], cuts[1::2] = start, end
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), cuts.size - 1,
        [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces.take(pa.array(np.arange(0, cuts.size - 1, 2))), per_row


def _collapse(least: int):
    def rows(batches):
        for b in slices(batches, _TEXT):
            words, per_row = _word_table(b.column(_TEXT))
            keep = [c for c in b.schema.names if c != _TEXT]
            numbers = np.asarray(words.dictionary_encode().indices, dtype=np.int64) \
                if len(words) else np.zeros(0, dtype=np.int64)
            row, start, length, period = find_runs(numbers, per_row, least)
            ends = np.cumsum(per_row)
            out = dropped(numbers.size, start + (ends - per_row)[row], length, period)
            left = words.filter(pa.array(~out))
            upto = np.concatenate([[0], np.cumsum(~out)])[np.concatenate([[0], ends])]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), left),
                                  pa.scalar(b" ", pa.large_binary()))
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row, np.arange(per_row.size + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                           names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), runs, text.cast(pa.large_string()).cast(pa.string())],
                names=[*keep, "runs", "collapsed"])
    return rows


def collapse_runs(docs: DataFrame, *keep: Column, least: int = LEAST_WORDS) -> DataFrame:
    """The ``keep`` columns of ``docs`` (text) with runs, by start and period (start is
    the number of the first word), and collapsed, the words that no run holds after its
    first period, joined by one space."""
    ready(docs.sparkSession)
    kept = docs.select(*keep)
    return docs.select(*keep, F.col("text").alias(_TEXT)) \
        .mapInArrow(_collapse(least), T.StructType(
            [*kept.schema.fields, T.StructField("runs", RUNS),
             T.StructField("collapsed", T.StringType())]))
