"""Exact top-k inner products by MaxScore over inverted shards.

A vector component is a term: its sign and dimension name the posting list, its
size is the impact. Only postings of the query's sign add to a score, so the
sum of (query weight x largest impact of the list) over some terms bounds what
these terms can add to any row. With the k-th best score known so far, a
query's terms are split: the non-essential ones together cannot reach it, the
others are essential. A shard traverses the essential postings, drops rows
whose partial sum plus the bound of the rest stays below, probes the remaining
terms for the rows left, and computes those rows' whole inner products.

Rows are dealt evenly over shards and queries over blocks. Each block first
meets one shard, which gives every query a first k-th score, then all shards;
a shard's answer holds at most k rows a query, and the answers are merged by a
ranked window with Spark's early group limit.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id. A shorter vector counts as padded
with zeros. Rows that repeat an id are candidates of their own, never for a
query of that id; each row of a repeated query id is answered. Empty tables
give no rows. Scores must fit a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prescient.llm.common import written
from prescient.session import ready

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
_NONE = -(1 << 62)


def quantise(vectors: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): components as floor(scale * x); rows that take no part are left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
                    .cast("long")).alias("v"))


def _matrix(lists) -> np.ndarray:
    width = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _packed(batches):
    """All rows of a task as one row: number, ids, width, components."""
    from pyspark import TaskContext
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is not None and t.num_rows:
        m = _matrix(t["v"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([np.asarray(t["id"], dtype=np.int64).tobytes()], pa.binary()),
             pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())],
            names=["n", "ids", "width", "m"])


def packs(rows: DataFrame, count: int, size: int) -> DataFrame:
    """``rows`` dealt evenly, about ``size`` to a pack."""
    return rows.repartition(max(1, -(-count // size))).mapInArrow(
        _packed, "n int, ids binary, width int, m binary")


class Shard:
    """Inverted lists of one pack."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        self.columns = np.ascontiguousarray(m.T)
        self.lists = {}
        for d, x in enumerate(self.columns):
            for sign in (1, -1):
                rows = np.flatnonzero(x * sign > 0)
                impact = np.abs(x[rows])
                self.lists[d, sign] = (rows, impact, int(impact.max()) if rows.size else 0)

    def top(self, query_id: int, q: np.ndarray, k: int, floor: int
            ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows with at least ``floor``, best first."""
        n = len(self.ids)
        if floor <= 0:  # rows without a posting could count too
            alive = np.arange(n)
        else:
            terms = [(abs(int(w)) * self.lists[d, 1 if w > 0 else -1][2], d, int(w))
                     for d, w in enumerate(q[:self.m.shape[1]]) if w]
            terms.sort(reverse=True)
            rest = np.concatenate([np.cumsum([t[0] for t in terms][::-1])[::-1], [0]])
            essential = int((rest[:len(terms)] >= floor).sum())
            sums = np.zeros(n, dtype=np.int64)
            for _, d, w in terms[:essential]:
                rows, impact, _ = self.lists[d, 1 if w > 0 else -1]
                sums[rows] += abs(w) * impact
            alive = np.flatnonzero(sums + rest[essential] >= floor)
            sums = sums[alive]
            for i in range(essential, len(terms)):
                if alive.size <= 4 * k:
                    break
                _, d, w = terms[i]
                sums += np.maximum(self.columns[d, alive] * w, 0)
                keep = sums + rest[i + 1] >= floor
                alive, sums = alive[keep], sums[keep]
        width = min(len(q), self.m.shape[1])
        score = self.m[alive, :width] @ q[:width]
        ok = (score >= floor) & (self.ids[alive] != query_id)
        alive, score = alive[ok], score[ok]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best]


def _search(k: int):
    """(query pack with floors, shard pack) rows to at most k rows a query."""
    def rows(batches):
        opened, shard = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["n"] != opened:
                    opened = r["n"]
                    shard = Shard(np.frombuffer(r["ids"], dtype=np.int64),
                                  np.frombuffer(r["m"], dtype=np.int64)
                                  .reshape(-1, r["width"]) if r["width"] else
                                  np.zeros((len(r["ids"]) // 8, 0), dtype=np.int64))
                q_ids = np.frombuffer(r["q_ids"], dtype=np.int64)
                q = np.frombuffer(r["q_m"], dtype=np.int64).reshape(len(q_ids), r["q_width"])
                floors = np.frombuffer(r["floors"], dtype=np.int64) if r["floors"] else \
                    np.full(len(q_ids), _NONE)
                no, qid, vid, score = [], [], [], []
                for i, one in enumerate(q_ids):
                    ids, s = shard.top(int(one), q[i], k, int(floors[i]))
                    no.append(np.full(len(ids), (r["q_n"] << 32) + i))
                    qid.append(np.full(len(ids), one))
                    vid.append(ids)
                    score.append(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (no, qid, vid, score)],
                    names=["query_no", "query_id", "vec_id", "score"])
    return rows


def _floors(k: int):
    """Each pack's queries' k-th scores, from its first shard's answers."""
    def of(pdf):
        import pandas as pd
        n = int(pdf["q_n"].iloc[0])
        found = pdf[pdf["score"].notna()]
        floors = np.full(int(pdf["size"].iloc[0]), _NONE)
        grouped = found.groupby(found["query_no"].astype("int64") & 0xFFFFFFFF)["score"]
        full = grouped.agg(["size", "min"])
        full = full[full["size"] >= k]
        floors[full.index.to_numpy()] = full["min"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"q_n": [n], "floors": [floors.tobytes()]})
    return of


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``candidates`` (id, v) for each of
    ``queries`` (id, v), by inner product, ties to the smaller id; a query's own id
    is no candidate. ``v`` are arrays of longs."""
    spark = candidates.sparkSession
    ready(spark)
    shards = written(packs(candidates, candidates.count(), shard_rows), "shards")
    blocks = written(packs(queries, queries.count(), block_queries).select(
        F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"),
        F.col("m").alias("q_m")), "query-blocks")
    numbers = sorted(r.n for r in shards.select("n").collect())  # one number a shard
    out = "query_no long, query_id long, vec_id long, score long"
    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    listed = F.array(*(F.lit(n) for n in numbers)) if len(numbers) < 1000 else \
        F.sequence(F.lit(0), F.lit(numbers[-1]))
    none = F.lit(None).cast("binary").alias("floors")
    first = blocks.withColumn("n", F.element_at(listed, (F.col("q_n") % F.size(listed) + 1)
                                                .cast("int"))) \
        .select("*", none).join(shards, "n").mapInArrow(_search(k), out)
    # Every pack gets floors, also one whose first shard found nothing.
    seen = first.select((F.shiftright("query_no", 32)).cast("int").alias("q_n"), "query_no", "score") \
        .unionByName(blocks.select("q_n", F.lit(None).cast("long").alias("query_no"),
                                   F.lit(None).cast("long").alias("score")))
    sizes = blocks.select("q_n", (F.octet_length("q_ids") / 8).cast("int").alias("size"))
    floors = written(seen.join(sizes, "q_n").groupBy("q_n")
                     .applyInPandas(_floors(k), "q_n int, floors binary"), "floors")
    pairs = blocks.join(floors, "q_n").withColumn("n", F.explode(listed)) \
        .repartition(F.col("n"), F.col("q_n"))
    found = pairs.join(shards, "n").mapInArrow(_search(k), out)
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
