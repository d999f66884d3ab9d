"""Snapshot tables: one row = one match at one frame.

Two ways in:

* ``read_snapshot_csv`` reads the study's own CSV layout with a declared
  schema (no inference), header on.
* ``snapshots_from_lineitem`` is the adapter over the driver's ``lineitem``
  table (see FIXTURES.md section 3); every query of this repo runs on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The snapshot schema of the study (31 fields).
OWN_FEATURES = [
    "Minerals", "Gas", "Supply", "TotalMinerals", "TotalGas", "TotalSupply",
    "GroundUnitValue", "BuildingValue", "AirUnitValue",
    "ObservedEnemyGroundUnitValue", "ObservedEnemyBuildingValue",
    "ObservedEnemyAirUnitValue",
]
ENEMY_FEATURES = ["Enemy" + f for f in OWN_FEATURES]

SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField("ReplayID", T.StringType()),
     T.StructField("Duration", T.IntegerType()),
     T.StructField("Frame", T.IntegerType())]
    + [T.StructField(f, T.IntegerType()) for f in OWN_FEATURES + ENEMY_FEATURES]
    + [T.StructField("ObservedResourceValue", T.DoubleType()),
       T.StructField("EnemyObservedResourceValue", T.DoubleType()),
       T.StructField("Winner", T.StringType()),
       T.StructField("Races", T.StringType())]
)

# The columns of a per-pairing file, by position: a whole-number id, 28
# numbers, the winner. The pairing is in the file's name only.
PAIRING_SCHEMA = T.StructType(
    [T.StructField("ReplayID", T.IntegerType())]
    + [T.StructField(f, T.DoubleType()) for f in
       ["Duration", "Frame", *OWN_FEATURES, *ENEMY_FEATURES,
        "ObservedResourceValue", "EnemyObservedResourceValue"]]
    + [T.StructField("Winner", T.StringType())])

# The five groups of own columns that the study draws, three columns each
# and the resources alone; the other side's column has the prefix.
FEATURE_GROUPS = [OWN_FEATURES[0:3], OWN_FEATURES[3:6], OWN_FEATURES[6:9], OWN_FEATURES[9:12],
                  ["ObservedResourceValue"]]
ENEMY_PREFIX = "Enemy"

#: Columns that ``read_pairings`` adds.
PAIRING, MALFORMED = "Races", "_malformed"

# Adapter columns (lineitem plays the part of the snapshot table).
ADAPTER_OWN = ["quantity", "price", "discount", "tax", "linenumber"]
ADAPTER_ENEMY = ["enemy_quantity", "enemy_price"]
# Numeric, non-negative features used by every learner (races joins as index).
NUMERIC_FEATURES = ["frame"] + ADAPTER_OWN + ADAPTER_ENEMY
# Own/enemy column pairs for the long (melted) table.
ADAPTER_PAIRS = [("quantity", "enemy_quantity"), ("price", "enemy_price")]

EPOCH = "1995-01-01"

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_shipdate"]


def read_snapshot_csv(spark: SparkSession, path: str,
                      schema: T.StructType = SNAPSHOT_SCHEMA) -> DataFrame:
    """CSV scan with header and a declared schema; a folder reads every part."""
    return (spark.read.option("header", "true").option("inferSchema", "false")
            .option("mode", "FAILFAST").schema(schema).csv(path))


def read_pairings(spark: SparkSession, paths: str | list[str], tags: list[str],
                  pattern: str, schema: T.StructType = PAIRING_SCHEMA,
                  tag_col: str = PAIRING) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of per-pairing CSV files with a header, read in one scan.

    Columns go by position with the declared ``schema``. ``tag_col`` is what group 1 of
    ``pattern`` finds in the file's path; a tag that is not in ``tags`` (or none) is an
    error, not a loss. Lines with another number of fields or with a value that is
    not of its type are rejects: (path, tag, line). Whole lines are parsed, whatever
    columns are read later, so a line is a reject or a row in every query.
    """
    held = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    rows = (spark.read.option("header", "true").option("inferSchema", "false")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
            .option("enforceSchema", "true")
            .schema(held).csv(paths))
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    known = F.when(found.isin(tags), found).otherwise(F.raise_error(F.concat(
        F.lit("unknown pairing in "), F.col("_metadata.file_path"))))
    rows = rows.withColumn("_path", F.col("_metadata.file_path")).withColumn(tag_col, known)
    # Only columns that a query reads are converted, so the test reads all of them.
    every = F.xxhash64(*[F.col(f.name) for f in schema.fields]).bitwiseAND(F.lit(0).cast("long"))
    rejected = F.coalesce(F.greatest(F.length(MALFORMED), every), F.lit(0)) > 0
    good = rows.where(~rejected).drop(MALFORMED, "_path")
    bad = rows.where(rejected).select(
        F.col("_path").alias("path"), tag_col, F.col(MALFORMED).alias("line"))
    return good, bad


def snapshots_from_lineitem(lineitem: DataFrame, with_duration: bool = False,
                            frame_below: int | None = None) -> DataFrame:
    """lineitem -> snapshot view.

    ``duration`` (max frame of the match) costs a shuffle by match id, so it
    is only added when asked. It is a partial aggregate joined back, not a
    window: a window would sort one hot match inside a single task, while the
    aggregate combines map-side and AQE splits a skewed join partition.

    ``frame_below`` keeps rows with frame < bound and states the bound on the
    raw column (``l_shipdate < epoch + bound days``), which the parquet scan
    can push down and use to skip row groups; ``frame`` itself is derived and
    cannot be pushed. Duration needs every row of a match, so with
    ``with_duration`` the bound is applied after it.
    """
    frame = F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH)).cast("int")
    li = lineitem.select(*LINEITEM_COLUMNS)
    if frame_below is not None and not with_duration:
        bound = F.to_timestamp_ntz(F.date_add(F.lit(EPOCH).cast("date"), int(frame_below)))
        li = li.where(F.col("l_shipdate") < bound)
    li = li.withColumn("frame", frame)
    row_key = F.concat_ws(
        "_", *[F.col(c).cast("string") for c in
               ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "frame")],
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    snaps = li.select(
        row_key.alias("row_key"),
        F.col("l_orderkey").cast("string").alias("replay_id"),
        "frame",
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"),
        (F.lit(51.0) - F.col("l_quantity")).alias("enemy_quantity"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("enemy_price"),
        F.col("l_returnflag").alias("races"),
        F.col("l_linestatus").alias("winner"),
    )
    if with_duration:
        snaps = add_duration(snaps)
        if frame_below is not None:
            snaps = snaps.where(F.col("frame") < frame_below)
    return snaps


def add_duration(snaps: DataFrame) -> DataFrame:
    dur = snaps.groupBy("replay_id").agg(F.max("frame").alias("duration"))
    return snaps.join(dur, "replay_id")
