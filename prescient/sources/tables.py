"""Readers for the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later reach the scan.

    Split sizes are the session's business (``spark.sql.files.maxPartitionBytes``);
    the reader adds no exchange.
    """
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
