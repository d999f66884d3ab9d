"""Token ids as raw binary shards with a minimal perfect hash index.

Writing: texts are ranged over shards by doc_id, sorted, encoded, and each
shard is one file in the shared folder::

    8 bytes  magic, then uint32 bytes of an id (2 or 4), uint32 zero
    payload  ids of all records one after the other, little endian
    int64 x records         doc_id (0 where null)
    uint8 x records         1 where doc_id is null
    uint64 x (records + 1)  first id of each record, counted from the payload's start
    uint64 records, uint64 payload bytes, 8 bytes magic

A task that runs again writes a file of another name; rows that Spark commits
name the file they belong to, so what lost attempts left is never read.

Index: keys are hashed over buckets of some 200,000; a bucket's minimal perfect
hash numbers its keys, and arrays by that number hold a 32-bit fingerprint,
the shard, the first record and the number of records. A lookup costs the same
for any number of keys and a foreign key is refused with probability 1 - 2^-32.

Defined results: null text is empty and its record holds only the end id. A
null doc_id is a key like any other and sorts first. Rows that repeat a doc_id
are records of their own, side by side in the order of their text's hash, and
the index gives the run; they may go on in the next shard. An empty table
gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescient.llm.common import scratch_folder, slices, written
from prescient.llm.mphf import PerfectHash
from prescient.llm.tokenizer import encoder
from prescient.session import ready

MAGIC = b"IDSHARD1"
#: Bytes of text that a shard holds, about.
SHARD_BYTES = 128 << 20
#: Keys in one bucket of the index, about.
BUCKET_KEYS = 200_000
_NULL_KEY = np.uint64(0xA5A5F00DC3C30FF1)


def file_at(uri: str):
    """(pyarrow file system, path on it) of a folder or file that all tasks share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else \
        (fs.LocalFileSystem(), uri)


def key_hash(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.where(null, _NULL_KEY, ids.view(np.uint64))


# -------------------------------------------------------------------- writing

def _write(folder: str, path: str, end_id: int, width: int):
    """Sorted (doc_id, text) rows of a task to one shard file and a row per record."""
    def rows(batches):
        import uuid

        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        encode = encoder(path).encode
        end = np.uint32(end_id).tobytes()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        sink, ids, sizes = None, [], []
        record = 0
        for b in slices(batches):
            if sink is None:
                filesystem, at = file_at(folder)
                filesystem.create_dir(at, recursive=True)
                sink = filesystem.open_output_stream(f"{at}/{name}")
                sink.write(MAGIC + np.array([width, 0], dtype="<u4").tobytes())
            size = []
            for text in b.column("text").to_pylist():
                code = encode(text or "") + end
                size.append(len(code) // 4)
                sink.write(code if width == 4 else
                           np.frombuffer(code, dtype="<u4").astype("<u2").tobytes())
            ids.append(b.column("doc_id"))
            sizes.append(np.array(size, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([shard] * b.num_rows, pa.int32()),
                 pa.array(np.arange(record, record + b.num_rows)),
                 pa.array(size, pa.int64()), pa.array([name] * b.num_rows, pa.string())],
                names=["doc_id", "shard", "record", "n_tokens", "file"])
            record += b.num_rows
        if sink is not None:
            column = pa.chunked_array(ids)
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
            sink.write(np.asarray(column.fill_null(0), dtype="<i8").tobytes())
            sink.write(np.asarray(column.is_null()).astype(np.uint8).tobytes())
            sink.write(first.tobytes())
            sink.write(np.array([record, int(first[-1]) * width], dtype="<u8").tobytes() + MAGIC)
            sink.close()
    return rows


class Shard:
    """One shard file, open for reading."""

    def __init__(self, folder: str, name: str):
        filesystem, at = file_at(folder)
        self.file = filesystem.open_input_file(f"{at}/{name}")
        end = self.file.size()
        tail = self.file.read_at(24, end - 24)
        if tail[16:] != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        self.records, payload = (int(x) for x in np.frombuffer(tail[:16], dtype="<u8"))
        self.width = int(np.frombuffer(self.file.read_at(4, 8), dtype="<u4")[0])
        n = self.records
        foot = self.file.read_at(8 * n + n + 8 * (n + 1), 16 + payload)
        self.doc_ids = np.frombuffer(foot, dtype="<i8", count=n)
        self.null = np.frombuffer(foot, dtype=np.uint8, count=n, offset=8 * n) == 1
        self.first = np.frombuffer(foot[9 * n:], dtype="<u8").astype(np.int64)

    def ids(self, record: int) -> np.ndarray:
        """Ids of one record as uint32."""
        lo, hi = self.first[record], self.first[record + 1]
        raw = self.file.read_at(int(hi - lo) * self.width, 16 + int(lo) * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


class TokenStore:
    """Written shards and their index."""

    def __init__(self, spark: SparkSession, folder: str, records: DataFrame, index: DataFrame,
                 buckets: int):
        self.spark, self.folder, self.index, self.buckets = spark, folder, index, buckets
        # One row a shard, so some thousand at most for each TB of text.
        found = records.groupBy("shard", "file").agg(
            F.count("*").alias("records"), F.sum("n_tokens").alias("tokens")).collect()
        n = max((r.shard for r in found), default=-1) + 1
        self.files = [""] * n
        self.records = np.zeros(n, dtype=np.int64)
        self.tokens = np.zeros(n, dtype=np.int64)
        for r in found:
            self.files[r.shard], self.records[r.shard], self.tokens[r.shard] = \
                r.file, r.records, r.tokens

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(shard, record, records) runs of the distinct keys in ``keys.doc_id``;
        unknown keys give no row."""
        records = self.records

        def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = {"shard": [], "record": [], "records": []}
            if len(left) and len(right):
                perfect, at = PerfectHash.from_bytes(right["blob"].iloc[0])
                null = left["doc_id"].isna().to_numpy()
                ids = left["doc_id"].fillna(0).to_numpy(dtype=np.int64)
                number = perfect.find(key_hash(ids, null))
                number = number[number >= 0]
                shard, record, left_over = (at[k][number].astype(np.int64)
                                            for k in ("shard", "record", "records"))
                while shard.size:  # a run may go on in the next shards
                    here = np.minimum(left_over, records[shard] - record)
                    out["shard"].append(shard)
                    out["record"].append(record)
                    out["records"].append(here)
                    more = left_over > here
                    shard, record, left_over = shard[more] + 1, np.zeros(more.sum(), np.int64), \
                        (left_over - here)[more]
            return pd.DataFrame({k: np.concatenate([*v, np.zeros(0, dtype=np.int64)])
                                 for k, v in out.items()})

        return bucketed(keys.select("doc_id").distinct(), self.buckets).groupBy("bucket") \
            .cogroup(self.index.groupBy("bucket")) \
            .applyInPandas(find, "shard long, record long, records long")

    def read(self, runs: DataFrame, with_ids: bool = True) -> DataFrame:
        """The records of ``lookup``'s runs, from the files: doc_id, start (ids of all
        records before it), n_tokens, ids_crc32 and, if wanted, ids."""
        folder, files = self.folder, self.files
        base = np.concatenate([[0], np.cumsum(self.tokens)])

        def rows(batches):
            opened, shard = -1, None
            for b in batches:
                out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                for s, r, n in zip(*(b.column(k).to_pylist()
                                     for k in ("shard", "record", "records")), strict=True):
                    if s != opened:
                        opened, shard = s, Shard(folder, files[s])
                    for i in range(r, r + n):
                        ids = shard.ids(i).tobytes()
                        out["doc_id"].append(None if shard.null[i] else int(shard.doc_ids[i]))
                        out["start"].append(int(base[s] + shard.first[i]))
                        out["n_tokens"].append(len(ids) // 4)
                        out["ids_crc32"].append(zlib.crc32(ids))
                        if with_ids:
                            out["ids"].append(ids)
                cols = [pa.array(out[k], pa.int64())
                        for k in ("doc_id", "start", "n_tokens", "ids_crc32")]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=list(out)[:len(cols)])

        return runs.repartition("shard").sortWithinPartitions("shard", "record") \
            .mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long"
                        + (", ids binary" if with_ids else ""))


def bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    null = pdf["doc_id"].isna().to_numpy()
    ids = pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64)
    keys = key_hash(ids, null)
    perfect = PerfectHash.build(keys)
    number = perfect.find(keys)
    arrays = {}
    for k in ("shard", "record", "records"):
        arrays[k] = np.zeros(len(pdf), dtype=np.int64)
        arrays[k][number] = pdf[k].to_numpy(dtype=np.int64)
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1],
                         "blob": [perfect.to_bytes(**arrays)]})


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                ids_below: int = 1 << 32, shard_bytes: int = SHARD_BYTES,
                bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order, an
    ``end_id`` after each document. ``folder`` must be one that all executors
    share. Ids are two bytes wide if all are below 65,536 (``ids_below``)."""
    spark = docs.sparkSession
    ready(spark)
    folder = folder or scratch_folder(spark, "token-store")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 -(-int(size.b or 0) // shard_bytes))
    order = ["doc_id", F.xxhash64("text")]
    records = written(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
                      .mapInArrow(_write(os.path.join(folder, "shards"), tokenizer, end_id,
                                         2 if ids_below <= 1 << 16 else 4),
                                  "doc_id long, shard int, record long, n_tokens long, file string"),
                      "token-records")
    buckets = max(1, -(-size.n // bucket_keys))
    runs = records.groupBy("doc_id").agg(
        F.min(F.expr("shard * 1000000000000L + record")).alias("at"), F.count("*").alias("records")) \
        .select("doc_id", F.expr("at div 1000000000000L").alias("shard"),
                F.expr("at % 1000000000000L").alias("record"), "records")
    index = bucketed(runs, buckets).groupBy("bucket").applyInPandas(_build, "bucket long, blob binary")
    path = os.path.join(folder, "index")
    index.write.parquet(path)
    return TokenStore(spark, os.path.join(folder, "shards"), records,
                      spark.read.schema(index.schema).parquet(path), buckets)
