"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by their
membership pattern (the sorted set of sources), which leaves a small network::

    start -> pattern   capacity: words of the pattern, once for each repetition,
                       at a cost that grows with the repetition (0, 1, 2, ...)
    pattern -> source  for each source of the pattern, no limit
    source -> end      capacity: the source's target

The cheapest largest flow says how many words of each pattern the mix takes
and repeats no pattern while another could serve the same source for less.
A pattern's whole rounds go to all its documents; the rest is drawn in the
order of a seeded hash until the next document would overshoot, and one more
document, the one that fits the remaining gap best, closes it.

Only counts by pattern and by (pattern, hash bucket) are gathered, never
documents. A pattern of n documents has about sqrt(n) buckets; the cumulative
sum runs over the buckets, then over the (hash, id, scan partition) groups of the
single bucket where the rest runs out, then over the rows of the one group, so no
task sorts a large source, nor all copies of one row.

Defined results: null or empty text has size 0 and is never taken. A null
source is a source of its own, after the others; an empty membership array is
the null source. Of rows that repeat an id and text as many are taken as the rest
allows (which of them makes no difference to the result).
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from prescient.llm.common import WORD_PATTERN, written
from prescient.session import ready

#: A document is taken at most so many times.
MOST_REPEATS = 3
#: Weights of the sources in order, repeated.
WEIGHTS = (1.0, 2.0, 3.0)
#: Membership patterns up to which all go through the flow and the plan is broadcast
#: (some 0.2 KB a pattern; the driver holds some 1 KB). Beyond it only the patterns
#: that share a source with a pattern of several do; a source that stands alone has
#: one pattern and its flow in closed form, to the same result.
MOST_PATTERNS = 50_000


# ---------------------------------------------------------------- the targets

def shares(sizes: list[int], weights: list[float], total: float,
           most: float = MOST_REPEATS) -> list[float]:
    """``total`` dealt by weight; a source stops at ``most`` times its size and its
    excess is dealt again by weight until none is above."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if weight <= 0 or left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.remove(i)
        left = max(0.0, total - math.fsum(out))
    return out


# ------------------------------------------------------------------- the flow

def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int],
                  repeats: int = MOST_REPEATS) -> dict[tuple[int, int], int]:
    """Words of each (pattern number, source number) in the cheapest largest flow.
    ``patterns``: (sources, words).

    Costs lie on the edges from the start alone and grow with the repetition, so the
    cheapest largest flow is found repetition by repetition: the r-th adds each
    pattern's words once more and the flow so far is augmented to a largest one, in
    rounds of shortest paths (breadth first) and a blocking flow over them.
    """
    n_p, n_s = len(patterns), len(quotas)
    pattern_of, source_of = [], []  # of each edge
    of_pattern: list[list[int]] = [[] for _ in range(n_p)]
    of_source: list[list[int]] = [[] for _ in range(n_s)]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            of_pattern[p].append(len(pattern_of))
            of_source[s].append(len(pattern_of))
            pattern_of.append(p)
            source_of.append(s)
    flow = [0] * len(pattern_of)
    left, room = [0] * n_p, list(quotas)

    def levels():
        """Distances of patterns and sources from the patterns with words left, as far
        as the nearest source with room; None if there is none."""
        of_p = [0 if x > 0 else -1 for x in left]
        of_s = [-1] * n_s
        front = [p for p in range(n_p) if left[p] > 0]
        while front:
            reached = []
            for p in front:
                for e in of_pattern[p]:
                    s = source_of[e]
                    if of_s[s] < 0:
                        of_s[s] = of_p[p] + 1
                        reached.append(s)
            if any(room[s] > 0 for s in reached):
                return of_p, of_s
            front = []
            for s in reached:
                for e in of_source[s]:
                    if flow[e] > 0 and of_p[pattern_of[e]] < 0:
                        of_p[pattern_of[e]] = of_s[s] + 1
                        front.append(pattern_of[e])
        return None

    def block(of_p, of_s):
        """Send along shortest paths until each is cut; edges are tried once."""
        next_p, next_s = [0] * n_p, [0] * n_s
        for start in [p for p in range(n_p) if left[p] > 0]:
            path: list[int] = []  # edges, to a source and back to a pattern in turn
            while left[start] > 0:
                if len(path) % 2 == 0:
                    p = pattern_of[path[-1]] if path else start
                    edges, at = of_pattern[p], next_p[p]
                    while at < len(edges) and of_s[source_of[edges[at]]] != of_p[p] + 1:
                        at += 1
                    next_p[p] = at
                    if at < len(edges):
                        path.append(edges[at])
                        continue
                    if not path:
                        break
                    next_s[source_of[path.pop()]] += 1  # no way on from this pattern
                    continue
                s = source_of[path[-1]]
                if room[s] > 0:
                    push = min([left[start], room[s], *(flow[e] for e in path[1::2])])
                    left[start] -= push
                    room[s] -= push
                    for i, e in enumerate(path):
                        flow[e] += -push if i % 2 else push
                    path = []
                    continue
                edges, at = of_source[s], next_s[s]
                while at < len(edges) and not (flow[edges[at]] > 0
                                               and of_p[pattern_of[edges[at]]] == of_s[s] + 1):
                    at += 1
                next_s[s] = at
                if at < len(edges):
                    path.append(edges[at])
                else:
                    next_p[pattern_of[path.pop()]] += 1

    for _ in range(repeats):
        for p, (_, words) in enumerate(patterns):
            left[p] += words
        while (found := levels()) is not None:
            block(*found)
    return {(p, s): x for p, s, x in zip(pattern_of, source_of, flow, strict=True) if x}


# ------------------------------------------------------------------- the mix

def mix(docs: DataFrame, sources: str = "sources", weights=WEIGHTS, seed: int = 1,
        repeats: int = MOST_REPEATS, number: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and an array column of source
    names): doc_id, size (words), source_size and target (each summed over the
    row's sources), taken (words, repeats counted) and times. With ``number``, a
    column of ``docs``, also that column."""
    spark = docs.sparkSession
    ready(spark)
    extra = [] if number is None else [number]
    null = F.array(F.lit(None).cast("string"))
    member = F.array_sort(F.array_distinct(F.coalesce(F.col(sources).cast("array<string>"), null)))
    sized = written(docs.select(
        *extra,
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.size(member) == 0, null).otherwise(member).alias("pattern"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h")), "mix-sizes")

    counted = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")) \
        .toArrow()
    found = [Row(pattern=p, size=z, n=n) for p, z, n in
             zip(*(counted[c].to_pylist() for c in ("pattern", "size", "n")), strict=True)]
    small = F.broadcast if len(found) <= MOST_PATTERNS else lambda df: df
    found.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    names = sorted({s for r in found for s in r.pattern}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r.pattern:
            sizes[number[s]] += r.size
    total = sum(r.size for r in found)
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(names))], total, repeats)
    tied = range(len(found))
    taken = [0] * len(found)
    if len(found) > MOST_PATTERNS:
        linked = {s for r in found if len(r.pattern) > 1 for s in r.pattern}
        tied = [p for p, r in enumerate(found) if r.pattern[0] in linked]
        taken = [min(math.floor(targets[number[r.pattern[0]]]), repeats * r.size) for r in found]
        for p in tied:
            taken[p] = 0
    flow = min_cost_flow([(tuple(number[s] for s in found[p].pattern), found[p].size) for p in tied],
                         [math.floor(t) for t in targets], repeats)
    for (i, _), words in flow.items():
        taken[tied[i]] += words
    plan = [(p, list(r.pattern), r.size, taken[p] // r.size if r.size else 0,
             taken[p] % r.size if r.size else 0,
             sum(sizes[number[s]] for s in r.pattern),
             math.fsum(targets[number[s]] for s in r.pattern),
             math.isqrt(r.n) + 1) for p, r in enumerate(found)]
    plan = spark.createDataFrame(
        plan, "p int, pattern array<string>, pattern_size long, rounds long, rest long, "
              "source_size long, target double, buckets long")

    # Seeded order of a pattern's documents: by bucket, then by hash, id, scan partition
    # (upper bits of the row number) and row.
    at = sized.join(small(plan), sized.pattern.eqNullSafe(plan.pattern)) \
        .select(*extra, "p", "doc_id", "size", "h", "rounds", "rest", "source_size", "target", "row",
                F.expr("cast(floor((shiftrightunsigned(h, 1) / 9223372036854775808D) * buckets)"
                       " as long)").alias("bucket"),
                F.struct("h", F.coalesce("doc_id", F.lit(-1)).alias("d"),
                         F.shiftright("row", 33).alias("part")).alias("g"))
    to_draw = at.where("rest > 0 and size > 0")
    sums = to_draw.groupBy("p", "bucket", "rest").agg(F.sum("size").alias("s"))

    def where_rest_runs_out(sums, *order):
        w = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("upto", F.col("before") + F.coalesce(F.sum("s").over(w), F.lit(0))) \
            .where("upto < rest and upto + s >= rest")

    edge = where_rest_runs_out(sums.withColumn("before", F.lit(0).cast("long")), "bucket") \
        .select("p", F.col("bucket").alias("edge"), F.col("upto").alias("before"))
    near = written(to_draw.join(small(edge), "p").where("bucket = edge")
                   .select("p", "edge", "before", "rest", "g", "row", "size"), "mix-edge")
    groups = near.groupBy("p", "edge", "before", "rest", "g").agg(F.sum("size").alias("s"))
    group = where_rest_runs_out(groups, "g").select("p", "edge", F.col("g").alias("edge_g"),
                                                    F.col("upto").alias("before"))
    inside = Window.partitionBy("p").orderBy("row")
    last = near.drop("edge", "before").join(small(group), "p").where("g = edge_g") \
        .withColumn("upto", F.col("before") + F.sum("size").over(inside)) \
        .where("upto <= rest").groupBy("p").agg(F.max("upto").alias("upto"), F.max("row").alias("cut"))
    cut = written(group.join(last, "p", "left").select(
        "p", "edge", "edge_g", F.coalesce("upto", "before").alias("upto"),
        F.coalesce("cut", F.lit(-1).cast("long")).alias("cut")), "mix-cut")  # a row a pattern
    drawn = F.expr("coalesce(rest > 0 and size > 0 and (bucket < edge or (bucket = edge and "
                   "(g < edge_g or (g = edge_g and row <= cut)))), false)")
    marked = at.join(small(cut), "p", "left").withColumn("drawn", drawn)
    # One more document closes the gap if that brings the sum nearer.
    gap = F.col("rest") - F.col("upto")
    best = marked.where(~F.col("drawn") & (F.col("size") > 0) & (gap > 0)
                        & (F.col("size") < 2 * gap)) \
        .groupBy("p").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("miss"), "g", "row"))
                          .alias("b")) \
        .select("p", F.col("b.row").alias("best"))
    times = F.col("rounds") + (F.col("drawn") | F.coalesce(F.col("row") == F.col("best"),
                                                           F.lit(False))).cast("long")
    return marked.join(small(best), "p", "left") \
        .withColumn("times", F.when(F.col("size") > 0, times).otherwise(F.lit(0).cast("long"))) \
        .select("doc_id", "size", "source_size", "target",
                (F.col("size") * F.col("times")).alias("taken"), "times", *extra)
