"""Sinks and result folders.

* ``write_csv`` / ``write_single_csv``: header CSV, many parts or one part
  (one part only for result tables whose size is set by parameters).
* ``materialize_once``: reuse a finished table, else compute and write it. It is
  written beside its place with a manifest and then renamed, so a crashed write
  leaves nothing at the place. The manifest holds the caller's key and what the
  inputs are: their files with lengths and modification times (through the
  Hadoop FileSystem of each path: HDFS, object stores, local disk); where either
  differs, the table is written anew. Threads that ask for one path at a time wait for
  the first: a second writer would delete files that the first one's readers still need.
* ``number_from_path``: the number in a result folder name, per row.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One part file, overwrite. ``coalesce(1)`` avoids a shuffle; meant for
    small result tables only."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


_MANIFEST = "_MANIFEST"
_WRITERS: dict[str, threading.Lock] = defaultdict(threading.Lock)


def fingerprint(*inputs: DataFrame) -> str:
    """Digest of the files behind ``inputs`` with their lengths and modification times.
    Folders are listed once each; nothing of the files is read."""
    lines = set()
    for df in inputs:
        spark = df.sparkSession
        hconf = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = {path(f).toUri().getPath() for f in df.inputFiles()}
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for st in path(folder).getFileSystem(hconf).listStatus(path(folder)):
                name = st.getPath().toUri().getPath()
                if name in files:
                    lines.add(f"{name}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                     fmt: str = "parquet", partition_by: list[str] | None = None,
                     schema=None, key: str = "", inputs: list[DataFrame] | None = None,
                     options: dict | None = None) -> DataFrame:
    """Read ``path`` if it was finished for the same ``key`` and the same files of
    ``inputs``; otherwise build and write it.

    CSV needs ``schema``: types are declared, never inferred ('007' stays text)."""
    if fmt == "csv" and schema is None:
        raise ValueError("a CSV table needs a schema")
    path = path.rstrip("/")
    want = json.dumps({"key": key, "inputs": fingerprint(*(inputs or []))})
    with _WRITERS[path]:
        if read_text(spark, f"{path}/{_MANIFEST}") != want:
            temp = f"{path}.{uuid.uuid4().hex}"
            w = build().write.options(**(options or {}))
            if partition_by:
                w = w.partitionBy(*partition_by)
            if fmt == "csv":
                w.option("header", "true").csv(temp)
            else:
                w.format(fmt).save(temp)
            write_text(spark, f"{temp}/{_MANIFEST}", want)
            replace_folder(spark, temp, path)
    if fmt == "csv":
        return spark.read.option("header", "true").schema(schema).csv(path)
    return spark.read.format(fmt).load(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, null if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over one that is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace_folder(spark: SparkSession, temp: str, path: str) -> None:
    """Put the finished folder ``temp`` at ``path``; an older one there goes."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
    if not fs.rename(_fs(spark, temp)[1], p):
        raise OSError(f"cannot rename {temp} to {path}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def number_from_path(pattern: str = r"measures_([0-9]+)") -> Column:
    """Number captured from the file path of each row (as int)."""
    return F.regexp_extract(F.input_file_name(), pattern, 1).cast("int")
