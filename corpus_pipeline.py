"""Corpus preparation: documents in, packed training sequences out.

Each stage works on all rows the stage before kept and is one operator of
``prescient.llm``; all but the last return the columns of ``documents``. Where an
operator decides by row, its decision comes back by a row number that is written
first, so rows without an id or with a repeated one have their own. Columns of any
name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescient.llm import langid
from prescient.llm.common import crc_bucket, lower_ascii, table, written
from prescient.llm.exact_dedup import exact_dedup
from prescient.llm.mixing import mix
from prescient.llm.near_dedup import near_duplicates
from prescient.llm.packing import pack
from prescient.llm.tokenizer import public_path
from prescient.session import ready

VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def _row(docs: DataFrame):
    return F.struct(*(docs[c] for c in docs.columns)).alias("row")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(number, row) as a written table, so that every later read sees the same numbers."""
    return written(docs.select(F.monotonically_increasing_id().alias("number"), _row(docs)), name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that identification rejects (no text, hardly a letter, or text
    that the learned languages together do not explain). A document of several
    languages stays. Learns from four fifths of the rows."""
    ready(spark)
    model = langid.train(docs.where(crc_bucket(F.col("doc_id"), 5) != 0))
    return langid.predict(docs, model, _row(docs)) \
        .where(~F.col("rejected")) \
        .select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once. Of rows with that
    id and an equal text the one with the smallest hash over all its columns stays, so
    reruns agree however the rows are dealt; rows equal in every column are one."""
    rows = _numbered(docs, "exact-rows")
    kept = exact_dedup(rows.select("row.doc_id", "row.text")).where("kept") \
        .select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    keyed = rows.select(
        F.col("row.doc_id").cast("long").alias("id"),
        F.sha2(lower_ascii(F.coalesce("row.text", F.lit(""))), 256).alias("sha"),
        F.struct(F.xxhash64(F.col("row").cast("string")).alias("hash"), "number").alias("order"))
    # Repeats of one row meet in the map-side aggregation, before the join.
    chosen = keyed.groupBy("sha", "id").agg(F.min("order").alias("first")) \
        .join(kept, F.col("id").eqNullSafe(F.col("kept_id"))
              & (F.col("sha") == F.col("text_sha256")), "left_semi").select("first.number")
    return rows.join(chosen, "number", "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays: the smallest doc_id, the
    rows without an id last."""
    rows = _numbered(docs, "near-rows")
    kept = near_duplicates(rows.select("number", "row.doc_id", "row.text"), number="number") \
        .where("stays").select(F.col("row").alias("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, so up to three rows."""
    rows = _numbered(docs, "mixed-rows")
    times = mix(rows.select("number", "row.doc_id", "row.text",
                            F.array("row.source").alias("sources")), number="number") \
        .where("times > 0").select("number", F.col("times").cast("int").alias("times"))
    return rows.join(times, "number") \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their token ids and places in sequences."""
    return pack(docs, public_path(VOCABULARY), END_ID)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed),
          ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL states neither the language stage nor the near-duplicate stage.
ORACLE_SQL = None
