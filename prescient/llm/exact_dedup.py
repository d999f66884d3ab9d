"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Senders: each scan task cuts its rows into blocks and, for each owner (a
   range of the fingerprint space), sorts the block's distinct fingerprints
   and sends their gaps Golomb-Rice coded. A text that fills a block is one
   fingerprint of it.
2. Owners decode what they were sent, find the fingerprints that occur in more
   than one place and answer each message with a bitmap, one bit a fingerprint.
3. Only texts whose fingerprint has a set bit (suspects) are shuffled, and they
   are compared byte by byte: they are grouped by the normalised text itself,
   copies meeting in the map-side aggregation first, so a group holding a third
   of all rows moves as one row a task.

The block table (ids, digests, coded fingerprints) is written to the shared
folder once, so senders and bitmaps agree after a lost executor.

Defined results: null text is the empty text. Rows with the same id and the
same text are copies like any others (they count in ``group_size`` and are all
kept or all dropped with their id). A null id never stays when its group holds
another; a group of null ids only stays (``keep_id`` null, ``kept`` true). An
empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.common import lower_ascii, written
from prescient.session import ready

#: Rows in a sender's block: at most this many digests are in one message set.
BLOCK_ROWS = 65_536
#: Fingerprints that one owner handles, on average.
OWNER_ROWS = 400_000
_BIT = "shiftleft(1L, cast(pmod(shiftright(h, 32), 64) as int))"
#: 64-bit words of the suspect filter: fixes the size of what is broadcast.
FILTER_WORDS = 1 << 19

_BLOCK = ("block long, owner int, size int, rice int, coded binary, ids binary, "
          "has_id binary, digests binary, places binary")


# ------------------------------------------------------------- Golomb-Rice code

def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(Rice parameter, code) of sorted distinct uint64 values: gaps with the
    quotient in unary and the rest in ``rice`` bits."""
    if values.size == 0:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // values.size
    rice = min(max(mean.bit_length() - 1, 0), 63)
    quotient = (gaps >> np.uint64(rice)).astype(np.int64)
    ends = np.cumsum(quotient + 1)  # each unary number is zeros closed by a one
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(rice, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return rice, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def golomb_decode(code: bytes, rice: int, size: int) -> np.ndarray:
    """The ``size`` values of a code."""
    if size == 0:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    tail = size * rice
    ones = np.flatnonzero(bits)[:size]
    quotient = np.diff(ones, prepend=-1) - 1
    at = int(ones[-1]) + 1
    rest = bits[at:at + tail].reshape(size, rice).astype(np.uint64)
    low = (rest << np.arange(rice, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(rice)) + low, dtype=np.uint64)


# -------------------------------------------------------------------- the steps

def _send(owners: int, bits: int, block_rows: int):
    """Blocks of (id, digest) rows to one message row per owner."""
    def rows(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        count = number = 0

        def flush():
            t = pa.Table.from_batches(held)
            id_col = t["doc_id"].combine_chunks()
            has = np.asarray(id_col.is_valid()).astype(np.uint8)
            ids = np.asarray(id_col.fill_null(0), dtype=np.int64)
            hexes = np.frombuffer("".join(t["sha"].to_pylist()).encode(), dtype="S64")
            digests = np.frombuffer(bytes.fromhex(hexes.tobytes().decode()),
                                    dtype=np.uint8).reshape(-1, 32)
            prints = digests[:, :8].copy().view(">u8").ravel().astype(np.uint64) \
                >> np.uint64(64 - bits)
            wide = prints if bits > 32 else prints << np.uint64(32 - bits)
            top = (wide >> np.uint64(bits - 32)) if bits > 32 else wide
            owner = ((top * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(prints, kind="stable")  # owners are ranges of prints
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            out = {n: [] for n in ("block", "owner", "size", "rice", "coded", "ids", "has_id",
                                   "digests", "places")}
            for rows_ in np.split(order, cuts):
                distinct, place = np.unique(prints[rows_], return_inverse=True)
                here = np.bincount(place) > 1
                rice, coded = golomb_encode(distinct)
                for k, v in (("block", (part << 32) + number), ("owner", owner[rows_[0]]),
                             ("size", distinct.size), ("rice", rice), ("coded", coded),
                             ("ids", ids[rows_].tobytes()), ("has_id", has[rows_].tobytes()),
                             ("digests", digests[rows_].tobytes()),
                             # place of each row's fingerprint; odd if it repeats in this block
                             ("places", (place * 2 + here[place]).astype(np.uint32).tobytes())):
                    out[k].append(v)
            return pa.RecordBatch.from_arrays(
                [pa.array(out["block"], pa.int64()), pa.array(out["owner"], pa.int32()),
                 pa.array(out["size"], pa.int32()), pa.array(out["rice"], pa.int32()),
                 *(pa.array(out[k], pa.binary()) for k in
                   ("coded", "ids", "has_id", "digests", "places"))], names=list(out))

        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                piece = b.slice(at, block_rows)
                if count + piece.num_rows > block_rows:
                    yield flush()
                    held, count, number = [], 0, number + 1
                held.append(piece)
                count += piece.num_rows
        if count:
            yield flush()
    return rows


def _answer(pdf):
    """An owner's messages to bitmaps of the fingerprints that others sent too."""
    import pandas as pd
    lists = [golomb_decode(c, r, s) for c, r, s in zip(pdf["coded"], pdf["rice"], pdf["size"],
                                                       strict=True)]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.split((counts > 1)[inverse], np.cumsum([x.size for x in lists])[:-1])
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"],
                         "bitmap": [np.packbits(x).tobytes() for x in shared]})


def _unpack(batches):
    """Message rows with their bitmaps to (doc_id, sha, suspect) rows."""
    for b in batches:
        for r in b.to_pylist():
            place = np.frombuffer(r["places"], dtype=np.uint32)
            bits = np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8))
            suspect = (bits[place >> 1] == 1) | (place & 1 == 1)
            ids = np.frombuffer(r["ids"], dtype=np.int64)
            missing = np.frombuffer(r["has_id"], dtype=np.uint8) == 0
            hexes = r["digests"].hex()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=missing),
                 pa.array([hexes[i:i + 64] for i in range(0, len(hexes), 64)], pa.string()),
                 pa.array(suspect)], names=["doc_id", "sha", "suspect"])


def suspects(docs: DataFrame, fingerprint_bits: int = 64,
             block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, sha, suspect) for every row of ``docs`` (doc_id, norm): sha is the
    digest of the normalised text; rows that are not suspects have no copy."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.sha2("norm", 256).alias("sha"))
    rows = docs.select("doc_id").count()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // owner_rows))
    sent = written(keyed.mapInArrow(_send(owners, fingerprint_bits, block_rows), _BLOCK),
                   "exact-blocks")
    answers = sent.select("block", "owner", "size", "rice", "coded").groupBy("owner") \
        .applyInPandas(_answer, "block long, owner int, bitmap binary")
    return sent.select("block", "owner", "ids", "has_id", "digests", "places") \
        .join(answers, ["block", "owner"]) \
        .select("ids", "has_id", "digests", "places", "bitmap") \
        .mapInArrow(_unpack, "doc_id long, sha string, suspect boolean")


def suspect_filter(prints: DataFrame) -> DataFrame:
    """(slot, bits): a one-hash Bloom filter of at most FILTER_WORDS rows."""
    h = F.xxhash64("sha")
    return prints.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("slot"), h.alias("h")) \
        .groupBy("slot").agg(F.bit_or(F.expr(_BIT)).alias("bits"))


def exact_dedup(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256. Texts are equal when identical after lower-casing A-Z;
    the largest doc_id of equal texts stays."""
    ready(docs.sparkSession)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    marked = written(suspects(norm, fingerprint_bits), "exact-suspects")
    suspect = marked.where("suspect").select("doc_id", "sha")

    # Shuffle suspects only: the filter's size is fixed, its false positives
    # form groups of one and fall away.
    h = F.xxhash64(F.sha2("norm", 256))
    slots = suspect_filter(suspect)
    groups = norm.withColumn("h", h).withColumn("slot", F.pmod("h", F.lit(FILTER_WORDS))) \
        .join(F.broadcast(slots), "slot") \
        .where(F.expr(f"bits & {_BIT} != 0")) \
        .groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")) \
        .select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    # Two different texts under one digest would make two groups of it: fail
    # loudly rather than tie a row to the wrong one.
    groups = groups.groupBy("sha").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.count("*").alias("texts")) \
        .select("sha", "keep_id", F.expr(
            "if(texts = 1, group_size, cast(raise_error('two texts share a SHA-256') as bigint))")
            .alias("group_size"))
    found = suspect.join(groups, "sha")
    alone = marked.where("not suspect").select(
        "sha", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return found.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"),
        F.col("sha").alias("text_sha256"))
