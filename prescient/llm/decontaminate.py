"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters (lower case), digits and all that is not ASCII. Each
distinct window of GRAM consecutive item words (a shorter item is one window) goes
into a set: sorted 64-bit hashes, each with its place in a buffer of the items' text
and the items that hold it. Tasks slide windows over the documents' words; a small
bitmap and the hashes find candidates, and the bytes of the words decide.

The set is built in blocks of at most ITEM_BYTES of item text, so what one broadcast
holds is bounded (some 30 bytes a window and 4 a window and item) whatever the size of
the benchmark; the items are cut to blocks by a running sum of their sizes over
ranges of ids. Each block is scanned against all documents and the hits of a document
are united; a benchmark within the bound is a single scan with no shuffle.

Long texts are scanned in parts of PART_BYTES that overlap by GRAM - 1 words.

Defined results: null, empty and wordless texts have no words and no hits; a null,
empty or wordless item has no window. Items of one id are one item, and count once;
the hits of an item without an id count, but it is no item in n_items. Every row of
the documents has its own result, repeated rows and null ids as well. An empty table
gives no rows, an empty benchmark no hits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prescient.llm.common import mix64, slices, text_buffer, written
from prescient.session import ready

#: Words of a window.
GRAM = 10
#: Text of the items of one broadcast set, at most (one longer item goes alone).
ITEM_BYTES = 8 << 20
#: Bytes of a text that are scanned at a time.
PART_BYTES = 4 << 20

#: A stretch of hit words: numbers of the first and the one after the last, and the
#: same as places in the UTF-8 bytes of the text.
SPAN = ("start", "end", "first_byte", "end_byte")
SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in SPAN]))
_TEXT, _ROW = "_leak_text", "_leak_row"

# Lower case, and a space for what is in no word (fixed values: the class
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z).
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ----------------------------------------------------------------- the windows

class Words:
    """The words of texts that lie one after the other: folded bytes, first and last
    byte of each word, its text and a hash of its bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = _FOLD[raw]
        word = self.raw != 32
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < raw.size)]
        first[inner] = word[inner]  # words never cross texts
        last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.diff(np.searchsorted(self.start, offsets))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        padded = np.concatenate([self.raw, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((self.raw.size + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        size = self.end - self.start
        h = size.astype(np.uint64) * _STEP
        todo, at = np.arange(size.size), 0
        while todo.size:
            left = np.minimum(size[todo] - at, 8).astype(np.uint64) * np.uint64(8)
            part = eight[self.start[todo] + at] & (~np.uint64(0) >> (np.uint64(64) - left))
            h[todo] = mix64(h[todo] ^ part) * _STEP
            at += 8
            todo = todo[size[todo] > at]
        return h

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of so many words in one text."""
        n = self.hash.size - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.full(n, length, dtype=np.uint64)
        for i in range(length):
            h = (h ^ self.hash[i:i + n]) * _STEP
            h ^= h >> np.uint64(32)
        left = np.repeat(self.first + self.count, self.count) - np.arange(self.hash.size)
        at = np.flatnonzero(left[:n] >= length)
        return at, h[at]

    def text(self, at: int, length: int) -> bytes:
        """The words of a window, joined by one space."""
        part = self.raw[self.start[at]:self.end[at + length - 1]].tobytes()
        return b" ".join(part.split())


class Grams:
    """A block of the benchmark: for each window length the sorted hashes of its
    distinct windows, the words of each and the items that hold it."""

    def __init__(self, ids: list, texts: list, gram: int = GRAM):
        self.ids = sorted({i for i in ids if i is not None})
        number = {i: n for n, i in enumerate(self.ids)}
        raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
        words = Words(raw, offsets)
        self.buffer = words.raw
        owner = np.array([number.get(i, -1) for i in ids], dtype=np.int64)
        row = np.repeat(np.arange(len(ids)), words.count)
        self.sets = {}
        for length in np.unique(np.minimum(words.count, gram)):
            if length == 0:
                continue
            at, h = words.windows(int(length))
            count = words.count[row[at]]
            mine = (count == length) | ((length == gram) & (count > gram))
            at, h = at[mine], h[mine]
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            bits = max(int(16 * new.size).bit_length(), 10)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.sets[int(length)] = (
                h[new], np.append(new, h.size), words.start[at].astype(np.int64),
                words.end[at + length - 1].astype(np.int64), owner[row[at]].astype(np.int32),
                bits, seen)

    def hits(self, words: Words):
        """(first word, length, items) of each window of ``words`` that an item holds."""
        for length, (hashes, upto, start, end, owner, bits, seen) in self.sets.items():
            at, h = words.windows(length)
            maybe = np.flatnonzero(seen[(h >> np.uint64(64 - bits)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            place = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
            same = hashes[place] == h
            known: dict[tuple[int, bytes], np.ndarray] = {}
            for i, p in zip(at[same].tolist(), place[same].tolist(), strict=True):
                text = words.text(i, length)
                items = known.get((p, text))
                if items is None:  # the items under this hash whose words are the same
                    items = known[p, text] = np.array(
                        [owner[k] for k in range(upto[p], upto[p + 1])
                         if b" ".join(self.buffer[start[k]:end[k]].tobytes().split()) == text],
                        dtype=np.int64)
                if items.size:
                    yield i, length, items


def _parts(raw: np.ndarray, words_before, part: int):
    """A long text in parts: (first byte, last byte); each begins GRAM - 1 words before
    the end of the one before and ends between words."""
    at = end = 0
    while end < raw.size:
        end = min(raw.size, end + part)
        gap = np.flatnonzero(_FOLD[raw[end:end + part]] == 32) if end < raw.size else [0]
        while len(gap) == 0:
            end = min(raw.size, end + part)
            gap = np.flatnonzero(_FOLD[raw[end:end + part]] == 32) if end < raw.size else [0]
        end += int(gap[0])
        yield at, end
        at = words_before(at, end)


def _spans(stretches) -> list[tuple[int, int, int, int]]:
    """Stretches (as SPAN) that overlap or touch as one, in order."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(stretches):
        if out and x[0] <= out[-1][1]:
            y = out[-1]
            out[-1] = (y[0], max(x[1], y[1]), y[2], max(x[3], y[3]))
        else:
            out.append(x)
    return out


def scan(grams: Grams, col: pa.Array, part: int = PART_BYTES, gram: int = GRAM):
    """(words, hit stretches, item numbers) of each text of ``col``."""
    raw, offsets = text_buffer(col)
    if len(col) == 1 and raw.size > part:
        return [_scan_long(grams, raw, part, gram)]
    words = Words(raw, offsets)
    found: dict[int, list] = {}
    ends = words.first + words.count
    for i, length, items in grams.hits(words):
        found.setdefault(int(np.searchsorted(ends, i, side="right")), []).append((i, length, items))
    out = []
    for r in range(len(col)):
        hits = found.get(r, [])
        out.append((int(words.count[r]),
                    _spans(_stretch(words, i, n, -int(words.first[r]), -int(offsets[r]))
                           for i, n, _ in hits),
                    _items(items for _, _, items in hits)))
    return out


def _stretch(words: Words, i: int, n: int, words_before: int, bytes_before: int):
    return (words_before + i, words_before + i + n, bytes_before + int(words.start[i]),
            bytes_before + int(words.end[i + n - 1]))


def _items(lists) -> np.ndarray:
    some = {id(x): x for x in list(lists)}  # many hits have one list
    every = np.unique(np.concatenate(list(some.values()))) if some else np.zeros(0, dtype=np.int64)
    return every[every >= 0]


def _scan_long(grams: Grams, raw: np.ndarray, part: int, gram: int):
    state = {"words": None, "number": 0}

    def before(at, end):
        w = state["words"]
        keep = min(gram - 1, w.start.size)
        state["number"] += w.start.size - keep
        return at + int(w.start[w.start.size - keep]) if keep else end

    spans, items, total = [], [], 0
    for at, end in _parts(raw, before, part):
        words = state["words"] = Words(raw[at:end], np.array([0, end - at]))
        total = state["number"] + words.start.size
        for i, n, who in grams.hits(words):
            spans.append(_stretch(words, i, n, state["number"], at))
            items.append(who)
        spans, items = _spans(spans), [_items(items)]
    return total, spans, _items(items)


# ------------------------------------------------------------------ the tables

def blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(block, id, text) of the items that have text, written; a block holds at most
    ``item_bytes`` of text or one item. Rows are dealt over ranges of hashes first, so
    only one sum a range is ordered in one task."""
    text = F.col("text")
    rows = benchmark.where(text.isNotNull() & (F.octet_length(text) > 0)).select(
        F.col("item_id").cast("string").alias("id"), "text",
        F.octet_length(text).cast("long").alias("size"),
        F.xxhash64("item_id", "text").alias("h")).distinct()
    rows = written(rows.withColumn("range", F.shiftright("h", 48)), "leak-items")
    sums = rows.groupBy("range").agg(F.sum("size").alias("s"))
    upto = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("h", "id", "text"))
    return rows.join(upto, "range") \
        .select(F.floor((F.col("before") + inside - F.col("size")) / item_bytes).cast("long")
                .alias("block"), "id", "text")


def _find(sent, part: int):
    def rows(batches):
        grams = sent.value
        for b in slices(batches, _TEXT, min(PART_BYTES, part)):
            keep = [c for c in b.schema.names if c != _TEXT]
            got = scan(grams, b.column(_TEXT), part)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([[dict(zip(SPAN, x, strict=True)) for x in g[1]] for g in got],
                          pa.list_(pa.struct([(n, pa.int64()) for n in SPAN]))),
                 pa.array([[grams.ids[i] for i in g[2]] for g in got], pa.list_(pa.string()))],
                names=[*keep, "n_words", "spans", "items"])
    return rows


#: Stretches of several scans that overlap or touch as one.
_UNION = """aggregate(array_sort(flatten(collect_list(spans))),
    cast(array() as array<struct<start:bigint,end:bigint,first_byte:bigint,end_byte:bigint>>),
    (a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct(
            'start', element_at(a, -1).start, 'end', greatest(s.end, element_at(a, -1).end),
            'first_byte', element_at(a, -1).first_byte,
            'end_byte', greatest(s.end_byte, element_at(a, -1).end_byte)))),
        concat(a, array(s))))"""


def find_leaks(docs: DataFrame, benchmark: DataFrame, *keep: Column,
               item_bytes: int = ITEM_BYTES, part: int = PART_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text) with n_words, spans (hit
    words as stretches, see SPAN) and items (ids of the items whose windows occur, as
    sorted strings). ``benchmark``: item_id, text."""
    spark = docs.sparkSession
    ready(spark)
    items = written(blocks(benchmark, item_bytes), "leak-blocks")
    numbers = [r.block for r in items.select("block").distinct().orderBy("block").collect()]
    several = len(numbers) > 1
    rows = docs.select(*keep, F.col("text").alias(_TEXT))
    names = rows.columns[:-1]
    if several:  # a row number ties the hits of several scans together
        rows = written(rows.select(F.monotonically_increasing_id().alias(_ROW), *rows.columns),
                       "leak-rows")
    kept = [f for f in rows.schema.fields if f.name != _TEXT and (f.name == _ROW or not several)]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()),
                           T.StructField("spans", SPANS),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    found = None
    for n, block in enumerate(numbers or [None]):
        mine = items.where(F.col("block") == F.lit(block)).select("id", "text").toArrow()
        sent = spark.sparkContext.broadcast(Grams(mine["id"].to_pylist(), mine["text"].to_pylist()))
        hits = rows.select(*(f.name for f in kept), _TEXT).mapInArrow(_find(sent, part), schema)
        if not several:
            return hits
        hits = written(hits if n == 0 else hits.where("size(spans) > 0"), "leak-hits")
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    united = found.groupBy(_ROW).agg(
        F.max("n_words").alias("n_words"), F.expr(_UNION).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.drop(_TEXT).join(united, _ROW).select(*names, "n_words", "spans", "items")


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without the bytes of ``spans`` (which begin and end at words, so no
    words run together)."""
    zero = F.lit(0).cast("long")
    starts = F.concat(F.array(zero), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["first_byte"]),
                    F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda s, e: F.substring(
        text.cast("binary"), (s + 1).cast("int"), (e - s).cast("int")).cast("string"))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans") -> DataFrame:
    """``docs`` without what it shares with the benchmark: ``spans`` cuts the hit words
    out of the texts, ``documents`` drops every document with one. Columns and other
    rows stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    found = find_leaks(docs, benchmark, row)
    if remove == "documents":
        return found.where("size(spans) = 0").select("row.*")
    return found.select(*(
        remove_spans(F.col("row.text"), F.col("spans")).alias(c) if c == "text"
        else F.col("row").getField(c).alias(c) for c in docs.columns))
