"""Helpers shared by the corpus operators: text batches as numpy arrays, word
hashes, written intermediate tables and id-set filters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescient.session import ensure_checkpoint_dir, ready, ship_package  # noqa: F401

# The white space of the word pattern [^\x20\x09-\x0D]+.
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step handles; longer documents go alone.
SLICE_BYTES = 6 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test folder."""
    ready(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the application ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and lets later reads take single columns."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        for f in {os.path.dirname(p) for p in df.inputFiles()}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(f)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


# ---------------------------------------------------------------- text slices

def slices(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffer(col)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets of the rows, one more than rows); null is empty."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, dtype=np.uint8)
    if n and col.null_count:
        lengths = np.diff(offsets)
        empty = np.asarray(col.is_null())
        if lengths[empty].any():
            return text_buffer(col.fill_null(""))
    return raw[offsets[0]:offsets[-1]] if n else raw[:0], offsets - (offsets[0] if n else 0)


def mix64(h: np.ndarray) -> np.ndarray:
    """Splitmix finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) of all words; words never cross rows."""
    if raw.size == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < raw.size]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = inner[inner > 0] - 1
    last[before] = word[before]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, A-Z lower-cased; words per row).

    Equal words have equal hashes in every task. Words are read eight bytes at
    a time; a word over 256 bytes is hashed on its own.
    """
    start, end, per_row = word_spans(raw, offsets)
    if start.size == 0:
        return np.zeros(0, dtype=np.uint64), per_row
    low = np.empty(raw.size + 8, dtype=np.uint8)
    np.take(_LOWER, raw, out=low[:raw.size])
    low[raw.size:] = 0
    eight = np.ndarray(shape=(raw.size + 1,), dtype="<u8", buffer=low.data, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * _GOLD
    todo = np.arange(start.size)
    big = np.flatnonzero(size > _LONG_WORD)
    if big.size:
        import hashlib
        for i in big:
            digest = hashlib.blake2b(low[start[i]:end[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, dtype="<u8")[0]
        todo = np.flatnonzero(size <= _LONG_WORD)
    at = 0
    while todo.size:
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        part = eight[start[todo] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        h[todo] = mix64(h[todo] ^ part) * _GOLD
        at += 8
        todo = todo[size[todo] > at]
    return h, per_row
