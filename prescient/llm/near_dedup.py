"""Near duplicates by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles. Equal sets are one
class. A class's MinHash signature has COORDINATES numbers and is posted under
each (coordinate, value) pair:

* Skip: a posting with one class joins nothing, so it goes; a class with fewer
  than MATCHES postings left cannot reach the match threshold and goes too.
* Prefix: a class's m postings left are ordered from rare to frequent. Two
  classes with MATCHES values in common share one among the first
  m - MATCHES + 1 of each, so only these are merged; a passage that many
  documents share comes last and mostly falls outside.
* Candidates are merged in rounds. In the first rounds every class meets the
  leader it shares most postings with (one candidate a class), which joins
  large groups of copies without their pairs. The first leader of a posting is
  its class of the most frequent values: in a group of altered copies often the
  text they come from.
* The last round takes what is still in different components. First an exact
  bound: a shingle that no other open class has is in no intersection, so the rest of
  a set limits how large a partner can be, and a posting loses the classes that
  no size in it can match. Texts that share a passage and have words of their own
  beside it, the common cause of long postings, go here, by one count of the open
  classes' shingles. What is left of a posting meets in blocks of about BLOCK, and a block pair counts in how many
  coordinates two classes agree, each pair at one posting only. Pairs that
  reach MATCHES are confirmed there on the full sets, unless they are already
  in one component, and only links that join components are emitted: at most
  one a class and block, however many pairs a common passage makes.
* Every candidate is confirmed on the full sets; confirmed links are merged into
  components as they are found.

The signature leaves out a pair of similarity 0.75 with probability 3.9e-6, one
of 0.77 with 6.9e-7 and one of 0.8 with 3.4e-8 (binomial tails of fewer than MATCHES
agreements of COORDINATES); nothing else leaves out a link.

Defined results: no text or no word gives an empty set, linked with nothing.
Fewer than five words are one shingle. A null doc_id is a document without a
name: it joins a component and can connect others, but the component takes the
smallest id that is not null; if it has none, component_id is null and one row
of it is kept, that of the least digest. Rows that repeat an id are documents of
their own that share it. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.common import SLICE_BYTES, mix64, slices, text_buffer, word_hashes, written
from prescient.llm.components import components
from prescient.session import ready

WORDS = 5
PERCENT = 75
COORDINATES = 48
#: Coordinates in which the signatures of a candidate pair agree, at least.
MATCHES = 22
#: Rounds in which a class meets one leader only.
LEADER_ROUNDS = 2
#: Classes in a block of the last round.
BLOCK = 500
#: Words of the bitmap that finds the candidates' texts again; fixes its size.
FILTER_WORDS = 1 << 19

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_POWER = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -------------------------------------------------------------- sets and signatures

def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = text_buffer(text)
    h, words = word_hashes(raw, offsets)
    n = max(h.size - WORDS + 1, 0)
    s = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        s += h[j:j + n] * _POWER[j]
    s = mix64(s)
    out, at = [], 0
    for k in words.tolist():
        if k >= WORDS:
            out.append(np.unique(s[at:at + k - WORDS + 1]))
        elif k:
            few = h[at:at + k] * _POWER[:k]
            out.append(mix64(np.array([few.sum(dtype=np.uint64) + np.uint64(k)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += k
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """int64 matrix (sets x COORDINATES); all sets hold something."""
    first = np.concatenate([[0], np.cumsum([x.size for x in sets])[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), dtype=np.uint64)
    for k in range(COORDINATES):
        v = (every + _ADD[k]) * _MULTIPLY[k]
        v ^= v >> np.uint64(32)
        v *= _MULTIPLY[-1 - k]
        out[:, k] = np.minimum.reduceat(v, first)
    return out.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(batches):
    for b in slices(batches, limit=SLICE_BYTES // 2):
        sets = shingle_sets(b.column("text"))
        size = np.array([x.size for x in sets])
        full = np.flatnonzero(size)
        sig = signatures([sets[i] for i in full]) if full.size else np.zeros((0, COORDINATES),
                                                                             dtype=np.int64)
        ends = np.cumsum((size > 0) * COORDINATES)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"),
             pa.array(size, pa.int64()),
             pa.array([digest(x) for x in sets], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                      pa.array(sig.ravel()))],
            names=["row", "doc_id", "n_shingles", "digest", "sig"])


# -------------------------------------------------------------- full sets of candidates

def _slot(digest_bytes: bytes) -> int:
    return int.from_bytes(digest_bytes[:8], "little") % (FILTER_WORDS * 64)


def _candidate_bits(digests: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for each digest."""
    def bits(batches):
        words = np.zeros(FILTER_WORDS, dtype=np.uint64)
        for b in batches:
            for d in b.column("digest").to_pylist():
                s = _slot(d)
                words[s >> 6] |= np.uint64(1 << (s & 63))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()),
                                          pa.array(words[at].view(np.int64))], names=["at", "bits"])

    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    rows = digests.mapInArrow(bits, "at long, bits long") \
        .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(rows["at"], dtype=np.int64)] = np.asarray(rows["bits"], dtype=np.int64).view(np.uint64)
    return out


def _sets_of(bits):
    def rows(batches):
        words, seen = bits.value, set()
        for b in slices(batches, limit=SLICE_BYTES // 2):
            out = []
            for x in shingle_sets(b.column("text")):
                if x.size:
                    d = digest(x)
                    s = _slot(d)
                    if int(words[s >> 6]) >> (s & 63) & 1 and d not in seen:
                        seen.add(d)
                        out.append((d, x.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in out], pa.binary()),
                     pa.array([x for _, x in out], pa.large_binary()).cast(pa.binary())],
                    names=["digest", "shingles"])
    return rows


def _confirm(percent: int):
    def rows(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(x.size, y.size) < percent * max(x.size, y.size):
                    continue
                if _similar(x, y, percent):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return rows


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
                   .mapInArrow(_confirm(percent), "a long, b long"), "links")


# -------------------------------------------------------------- candidates

def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (x.size + y.size - both)


def _block_links(matches: int, percent: int):
    """Classes of a posting, one block against another: confirmed links that join
    components. A pair is met at the first posting that both have, by coordinate."""
    coordinates = np.arange(COORDINATES)

    def links(t: pa.Table) -> pa.Table:
        block, i_, j_, node, comp, size, mask = (np.asarray(t[c]) for c in (
            "block", "i", "j", "node", "label", "size", "mask"))
        comp = comp.copy()
        sig = np.asarray(t["sig"].combine_chunks().flatten()).reshape(-1, COORDINATES)
        posted = ((mask[:, None] >> coordinates) & 1).astype(bool)
        pos = t["pos"][0].as_py()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64)
                for c in t["shingles"].chunks for x in c]
        first = block == i_
        same = i_[0] == j_[0]
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        a, b = [], []
        for i in left:
            near = right[right > i] if same else right
            near = near[(comp[near] != comp[i])
                        & (100 * np.minimum(size[near], size[i])
                           >= percent * np.maximum(size[near], size[i]))]
            equal = sig[near] == sig[i]
            count = equal.sum(axis=1)
            keep = (count >= matches) & ((equal & posted[near] & posted[i]).argmax(axis=1) == pos)
            near, count = near[keep], count[keep]
            for j in near[np.argsort(-count, kind="stable")]:
                if comp[j] != comp[i] and _similar(sets[i], sets[j], percent):
                    a.append(node[i])
                    b.append(node[j])
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return links


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with each class's component, without those in one component only."""
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    with_label = postings.join(labels, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    open_ = with_label.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
        .where("lo <> hi").select("key")
    return with_label.join(open_, "key")


def _leader_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """One candidate a class: the leader it shares most postings with, of another
    component. The leader of a posting is its class of the most frequent values in
    the first round, then one by hash."""
    p = -F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), F.col("node"))
    leaders = postings.groupBy("key").agg(F.min_by("node", p).alias("leader"),
                                          F.min_by("label", p).alias("led"))
    return postings.join(leaders, "key").where("label <> led") \
        .groupBy("node", "leader").agg(F.count("*").alias("n")) \
        .groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best")) \
        .select(F.least("node", "best.leader").alias("a"),
                F.greatest("node", "best.leader").alias("b")).distinct()


def _shingle_rows(batches):
    for b in batches:
        for node, x in zip(b.column("node"), b.column("shingles"), strict=True):
            s = np.frombuffer(x.as_buffer(), dtype=np.int64)
            for at in range(0, s.size, 1 << 16):
                part = s[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(part.size, node.as_py()))],
                    names=["shingle", "node"])


def bounded(postings: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``postings`` (key, node, label, ...) without the classes that can link with none of
    their posting, and without postings of one component.

    Of a class of ``size`` shingles, ``shared`` are in another open class. A partner's
    size is at most hi = shared (100 + percent) / percent - size, as the intersection is
    at most shared and the union the rest. A class can be the smaller of a pair if hi is
    not below its own size, the larger if hi reaches the smallest class that can.
    """
    nodes = postings.select("node").distinct()
    alone = sets.join(nodes, "node", "left_semi").select("node", "shingles") \
        .mapInArrow(_shingle_rows, "shingle long, node long") \
        .groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")) \
        .where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    bound = nodes.join(classes.select("node", "size"), "node").join(alone, "node", "left").select(
        "node", "size", F.expr(f"(size - coalesce(own, 0)) * {100 + percent} div {percent} - size")
        .alias("hi"))
    marked = written(postings.join(bound, "node"), "open-bounds")
    least = marked.where("hi >= size").groupBy("key").agg(F.min("size").alias("least"))
    left = marked.join(least, "key").where("hi >= size or hi >= least") \
        .drop("size", "hi", "least")
    open_ = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("up")) \
        .where("lo <> up").select("key")
    return left.join(open_, "key")


def _signature_links(postings: DataFrame, classes: DataFrame, sets: DataFrame, matches: int,
                     percent: int, block: int) -> DataFrame:
    """Links among each posting's classes that join components."""
    postings = written(bounded(postings, classes, sets, percent), "open-bounded")
    # Postings with the very same classes meet once.
    h = F.xxhash64("node")
    keys = postings.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"),
                                       F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
    keys = keys.groupBy("n", "x", "y").agg(F.min("key").alias("key")) \
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    once = written(postings.join(keys, "key"), "open-once")
    mask = once.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("mask"))
    members = mask.join(classes, "node").join(sets, "node")
    dealt = once.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", "pos", "node", "label", "block", F.least("block", "other").alias("i"),
                F.greatest("block", "other").alias("j"))
    return dealt.join(members, "node").groupBy("key", "i", "j") \
        .applyInArrow(_block_links(matches, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES,
                    block: int = BLOCK, number: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id
    (smallest doc_id reachable over links), kept, n_class (documents of equal set).
    With ``number``, a column of distinct whole numbers from 0 that never change, also
    that number as ``row`` and ``stays``, true for one row of each component."""
    spark = docs.sparkSession
    ready(spark)
    row = F.monotonically_increasing_id() if number is None else F.col(number)
    texts = docs.select(row.cast("long").alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(
        _describe, "row long, doc_id long, n_shingles long, digest binary, sig array<long>"),
        "shingled")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.count("*").alias("n_class"))
    classes = written(classes, "classes")
    signed = written(rows.join(classes, rows.row == classes.node)
                     .select("node", F.col("n_shingles").alias("size"), "sig"), "signatures")

    key = F.xxhash64("pos", "col").alias("key")
    posted = signed.select("node", F.posexplode("sig")).select("node", "pos", key)
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = posted.join(shared, "key").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "key", "pos"))).alias("keys")) \
        .where(F.size("keys") >= matches)
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    prefix = F.slice("keys", F.lit(1), F.size("keys") - (matches - 1))
    postings = written(live.select("node", weight.alias("weight"), F.inline(prefix))
                       .select("node", "weight", "key", "pos"), "postings")

    wanted = postings.select("node").distinct().join(classes, "node").select("node", "digest")
    wanted = written(wanted, "candidates")
    bits = spark.sparkContext.broadcast(_candidate_bits(wanted.select("digest")))
    sets = written(texts.select("text").mapInArrow(_sets_of(bits), "digest binary, shingles binary")
                   .join(wanted, "digest").groupBy("node").agg(F.first("shingles").alias("shingles")),
                   "sets")

    labels = None
    for turn in range(LEADER_ROUNDS + 1):
        open_ = written(_labelled(postings, labels), "open-postings")
        if open_.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            links = confirmed(_leader_pairs(open_, turn), sets, percent)
        else:
            links = _signature_links(open_, signed, sets, matches, percent, block)
        if labels is not None:  # between components
            for end in ("a", "b"):
                links = links.join(labels.toDF(end, "of"), end, "left") \
                    .withColumn(end, F.coalesce("of", end)).drop("of")
        merged = components(links)
        if labels is None:
            labels = merged
        else:
            moved = merged.toDF("label", "to")
            old = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label"))
            new = merged.join(labels.select("node"), "node", "left_anti").select("node", "label")
            labels = written(old.union(new), "labels")

    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    named = rows.select("row", "doc_id", "n_shingles", "digest") \
        .join(classes.select("digest", "node", "n_class"), "digest", "left") \
        .join(labels, "node", "left") \
        .withColumn("label", F.coalesce("label", "node", -F.col("row") - 1))
    first = named.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "digest", "row")).alias("first")) \
        .select("label", F.col("first.doc_id").alias("component_id"),
                F.col("first.row").alias("first_row"))
    stays = F.col("row") == F.col("first_row")
    extra = [] if number is None else ["row", stays.alias("stays")]
    return named.join(first, "label").select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), stays).alias("kept"),
        F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"), *extra)
