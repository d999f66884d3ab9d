"""Inputs shared by the registered queries.

``snapshots`` is the lineitem adapter; ``predictions`` scores the test rows
of five repeated splits with six classifiers (FIXTURES.md section 3):

* MAJ   majority label of the split's training rows (fitted, zero-rule)
* NB    multinomial Naive Bayes fitted on the split's training rows
* QTY   quantity > 25 -> 'O'      * TAX   tax > 0.04 -> 'O'
* PRICE price > 45000 -> 'O'      * HASH  md5 bucket of the row is odd -> 'O'

The four rules stand in for classifiers that SQL can state; MAJ and NB are
real fits by the library. The snapshots are written once with a bit a split
(``split_table``) and reused while the input files stay the same; one pass over
them fits both for all splits, a second scores the test rows with all six.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescient.operators import naive_bayes as nb
from prescient.operators import split
from prescient.session import scratch_path
from prescient.sources import sinks
from prescient.sources.snapshots import NUMERIC_FEATURES, snapshots_from_lineitem
from prescient.sources.tables import read_table

N_SPLITS = 5
# The six classifier names of the prediction table.
CLASSIFIERS = ["MAJ", "NB", "QTY", "TAX", "PRICE", "HASH"]


def snapshots(spark: SparkSession, sf_dir: str, with_duration: bool = False,
              frame_below: int | None = None) -> DataFrame:
    return snapshots_from_lineitem(read_table(spark, sf_dir, "lineitem"), with_duration,
                                   frame_below)


def split_table(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """The snapshots, each stored once, with the bits of the splits it trains in
    (``train_bits``) and of an odd md5 value (``odd_bits``).

    Row groups of 16 MB let a scan of a small table spread over tasks; the order by
    frame, in chunks that bound what a task holds, lets a cutoff filter skip pages.
    """
    rows = snapshots(spark, sf_dir)
    return sinks.materialize_once(
        spark, scratch_path(spark, "splits-" + hashlib.md5(sf_dir.encode()).hexdigest()[:12]),
        lambda: split.sorted_chunks(split.split_bits(rows, n_splits, odd_col="odd_bits"), "frame"),
        key=f"md5-70-30|{n_splits}", inputs=[rows], options={"parquet.block.size": str(16 << 20)})


def split_rows(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """Every snapshot once a split, with its part."""
    return split.of_split(split_table(spark, sf_dir, n_splits), n_splits, None) \
        .drop("train_bits", "odd_bits")


def nb_sums(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """Class counts and feature sums of the training rows of every split."""
    return nb.class_sums_by_bits(split_table(spark, sf_dir, n_splits), NUMERIC_FEATURES, n_splits)


def nb_params(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """Naive Bayes of every split, smoothing 1."""
    return nb.params_from_sums(nb_sums(spark, sf_dir, n_splits), len(NUMERIC_FEATURES),
                               group_cols=["test_set"])


def test_rows(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """Every snapshot once for each split where it is a test row."""
    return split.of_split(split_table(spark, sf_dir, n_splits), n_splits)


def scored(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """Test rows of every split with a column of predictions for each of CLASSIFIERS."""
    out = nb.predict(test_rows(spark, sf_dir, n_splits), nb_params(spark, sf_dir, n_splits),
                     NUMERIC_FEATURES, group_cols=["test_set"], out_col="NB", majority_col="MAJ")

    def rule(cond):
        return F.when(cond, F.lit("O")).otherwise(F.lit("F"))

    return out.select("row_key", "test_set", "frame", "winner", "MAJ", "NB",
                      rule(F.col("quantity") > 25).alias("QTY"),
                      rule(F.col("tax") > 0.04).alias("TAX"),
                      rule(F.col("price") > 45000).alias("PRICE"),
                      rule(split.bit("odd_bits", F.col("test_set"))).alias("HASH"))


def predictions(spark: SparkSession, sf_dir: str, n_splits: int = N_SPLITS) -> DataFrame:
    """``scored`` as one row for each classifier."""
    return scored(spark, sf_dir, n_splits).select(
        "row_key", "test_set", "frame", "winner",
        F.inline(F.array(*[F.struct(F.lit(c).alias("classifier"), F.col(c).alias("prediction"))
                           for c in CLASSIFIERS])))
