"""Packing documents into sequences of a fixed number of tokens.

Best fit on a histogram. Every document becomes pieces of at most ``capacity``
tokens, so the whole problem is one count for each length: as many numbers as
the capacity, whatever the corpus. On those counts:

* large pieces (over a third of the capacity) go at most two to a sequence, by
  greedy matching: the longest takes the longest partner that fits;
* smaller pieces, longest first, each go to the sequence with the smallest gap
  that holds them, or open a new one.

Equal sequences are planned once with their number, so the plan is some
thousand rows at most. A piece finds its place by its rank among the pieces of
its length: its place in its task's output plus the counts of the tasks before.

Defined results: null text is empty and gives one piece, the end id. Repeated
rows are documents of their own and share their doc_id; a null doc_id stays
null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prescient.llm.common import slices, written
from prescient.llm.tokenizer import encoder
from prescient.session import ready

CAPACITY = 1024


# ------------------------------------------------------------------ the plan

def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, pieces of it), ...])] for ``counts`` pieces
    of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    third = capacity // 3  # lengths above it are large
    by_gap: dict[int, list] = {}

    def put(number, items):
        gap = capacity - sum(size * n for size, n in items)
        by_gap.setdefault(gap, []).append((int(number), items))

    for size in range(capacity, third, -1):
        while left[size]:
            partner = min(size, capacity - size)
            while partner > third and (left[partner] == 0
                                       or partner == size and left[size] < 2):
                partner -= 1
            if partner <= third:
                put(left[size], [(size, 1)])
                left[size] = 0
            elif partner == size:
                put(left[size] // 2, [(size, 2)])
                left[size] %= 2
            else:
                n = min(left[size], left[partner])
                put(n, [(size, 1), (partner, 1)])
                left[size] -= n
                left[partner] -= n
    for size in range(third, 0, -1):
        n = int(left[size])
        while n:
            gap = next((g for g in range(size, capacity) if by_gap.get(g)), capacity)
            each = gap // size
            number, items = by_gap[gap].pop() if gap < capacity else (-(-n // each), [])
            full = min(number, n // each)
            if full:
                put(full, [*items, (size, each)])
            n -= full * each
            number -= full
            if n and number:  # one more sequence takes the rest
                put(1, [*items, (size, n)])
                n = 0
                number -= 1
            if number and items:
                put(number, items)
    return [b for g in sorted(by_gap) for b in by_gap[g]]


def plan_slots(bins, capacity: int) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by (length, first rank): key, first sequence, pieces
    of that length in a sequence, offset of the first of them."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for number, items in bins:
        at = 0
        for size, n in items:
            rows.append(((size << 44) + int(used[size]), base, n, at))
            used[size] += number * n
            at += size * n
        base += number
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else \
        tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


# ------------------------------------------------------------------ the pieces

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def rows(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        encode = encoder(path).encode
        end = np.uint32(end_id).tobytes()
        for b in slices(batches):
            doc, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for k, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(),
                               strict=True):
                code = encode(text or "") + end
                n = len(code) // 4
                at, i = 0, 0
                size = n % capacity or capacity
                while at < n:
                    cut = code[4 * at:4 * (at + size)]
                    doc.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    nth.append(seen[size])
                    seen[size] += 1
                    if with_ids:
                        ids.append(cut)
                    at, i, size = at + size, i + 1, capacity
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()),
                    pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return rows


def _place(slots):
    key, base, each, first = slots

    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length = np.asarray(b.column("length"))
            k = (length << 44) + np.asarray(b.column("nth")) + np.asarray(b.column("before"))
            i = np.searchsorted(key, k, side="right") - 1
            q = k - key[i]
            seq = base[i] + q // each[i]
            offset = first[i] + q % each[i] * length
            keep = [n for n in b.schema.names if n not in ("part", "nth", "before")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(seq), pa.array(offset)],
                names=[*keep, "sequence_id", "offset"])
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
         with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset and, if wanted, the piece's ids as
    little-endian uint32. A document over ``capacity`` ids is cut into pieces of
    ``capacity``, the first one shorter if need be; other documents stay whole."""
    ready(docs.sparkSession)
    schema = _PIECE + (", ids binary" if with_ids else "")
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                     .mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), schema),
                     "pieces")
    by_task = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(plan_bins(counts, capacity), capacity)
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "part",
                            F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" \
        + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return pieces.join(before, ["length", "part"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                *(["ids"] if with_ids else []), "part", "nth", "before") \
        .mapInArrow(_place(slots), out)
