"""Splits, repeated splits and folds (deterministic, partition-independent).

* ``hash_split``: row-level 70/30 split from an md5 bucket of the key.
* ``split_bits``: the same for splits 1..n as one whole number a row, a bit a
  split, so each row is hashed and stored once; ``of_split`` expands the rows of
  one side (the test rows of five splits are 1.5 copies, not 5).
* ``repeated_splits``: every row once a split, with its part.
* ``fold_assignment``: k folds from the hash (what CrossValidator needs as
  ``foldCol``).
* ``stratified_split`` / ``stratified_folds``: exact per-label proportions.
  They need each row's rank inside its label in md5 order. A window over the
  label would sort a whole class (half the table) in one task, so the rank is
  computed in two levels: a histogram of the leading md5 bits per label (a
  partial aggregate, at most 2^bits rows per label) gives each bucket's
  offset by a running sum, and only rows inside one bucket are sorted
  together. Work per task is bounded by the bucket size, not the class size.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prescient.functions.hashing import BUCKETS, TRAIN_BUCKETS, md5_bucket


def hash_split(df: DataFrame, salt, key: str = "row_key",
               train_buckets: int = TRAIN_BUCKETS, buckets: int = BUCKETS,
               part_col: str = "part", bucket_col: str | None = None) -> DataFrame:
    """Tag each row 'train' or 'test' (train share = train_buckets/buckets).

    ``bucket_col`` keeps the bucket (md5 value mod ``buckets``) for reuse.
    """
    b = md5_bucket(salt, key) % buckets
    if bucket_col:
        df = df.withColumn(bucket_col, b)
        b = F.col(bucket_col)
    return df.withColumn(part_col, F.when(b < train_buckets, F.lit("train"))
                         .otherwise(F.lit("test")))


def repeated_splits(df: DataFrame, n_splits: int = 5, key: str = "row_key",
                    train_buckets: int = TRAIN_BUCKETS,
                    split_col: str = "test_set") -> DataFrame:
    """Every row once per split 1..n with its part; salt = split id."""
    out = df.withColumn(split_col, F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    return hash_split(out, F.col(split_col), key, train_buckets, bucket_col="bucket")


def split_bits(df: DataFrame, n_splits: int = 5, key: str = "row_key",
               train_buckets: int = TRAIN_BUCKETS, buckets: int = BUCKETS,
               bits_col: str = "train_bits", odd_col: str | None = None) -> DataFrame:
    """Bit s - 1 of ``bits_col`` is set where the row is a training row of split s.
    ``odd_col``: the same for an odd md5 value. At most 31 splits."""
    if not 1 <= n_splits <= 31:
        raise ValueError("1 to 31 splits")
    ids = [f"_bucket{s}" for s in range(1, n_splits + 1)]
    for s, c in enumerate(ids, 1):
        df = df.withColumn(c, md5_bucket(s, key) % buckets)

    def mask(flag):
        out = F.lit(0)
        for s, c in enumerate(ids):
            out = out.bitwiseOR(F.when(flag(F.col(c)), F.lit(1 << s)).otherwise(F.lit(0)))
        return out
    df = df.withColumn(bits_col, mask(lambda b: b < train_buckets))
    if odd_col:
        df = df.withColumn(odd_col, mask(lambda b: b % 2 == 1))
    return df.drop(*ids)


def bit(bits_col: str, split) -> Column:
    """Whether the bit of ``split`` (a number or column) is set."""
    s = split if isinstance(split, Column) else F.lit(int(split))
    return F.call_function("shiftright", F.col(bits_col), s - 1).bitwiseAND(F.lit(1)) == 1


def of_split(df: DataFrame, n_splits: int = 5, train: bool | None = False,
             bits_col: str = "train_bits", split_col: str = "test_set") -> DataFrame:
    """Every row once for each split where it is a test (or training) row; with
    ``train`` None for every split, with its ``part``."""
    out = df.withColumn(split_col, F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    is_train_row = bit(bits_col, F.col(split_col))
    if train is None:
        return out.withColumn("part", F.when(is_train_row, F.lit("train")).otherwise(F.lit("test")))
    return out.where(is_train_row if train else ~is_train_row)


def sorted_chunks(df: DataFrame, col: str, rows: int = 1 << 18) -> DataFrame:
    """``df`` with each ``rows`` consecutive rows of a partition in the order of ``col``
    (nulls first), so that a task holds no more than those; a sort of the whole
    partition holds all of it."""
    def fn(batches):
        held, n = [], 0

        def ordered():
            t = pa.Table.from_batches(held)
            at = pc.sort_indices(t, sort_keys=[(col, "ascending")], null_placement="at_start")
            yield from t.take(at).combine_chunks().to_batches(max_chunksize=10_000)
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from ordered()
                held, n = [], 0
        if n:
            yield from ordered()
    return df.mapInArrow(fn, df.schema)


def by_match(df: DataFrame, salt, match_col: str = "replay_id",
             train_buckets: int = TRAIN_BUCKETS) -> DataFrame:
    """Match-level variant: all snapshots of a match land on the same side."""
    return hash_split(df, salt, match_col, train_buckets)


def fold_assignment(df: DataFrame, k: int = 10, seed: int = 7,
                    key: str = "row_key", fold_col: str = "fold") -> DataFrame:
    return df.withColumn(fold_col, (md5_bucket(F.lit(f"fold{seed}"), key) % k).cast("int"))


def _hex_order(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws("_", F.lit(seed), F.col(key).cast("string")))


def rank_within_label(df: DataFrame, label: str, seed: str, key: str = "row_key",
                      bucket_hex: int = 4, rank_col: str = "rank_in_label",
                      size_col: str = "label_size") -> DataFrame:
    """1-based rank of each row inside its label, ordered by (md5(seed_key), key).

    Also returns the label size. Exact; no task sees more than one md5
    bucket of one label (16^bucket_hex buckets per label: with the default
    4, a histogram of at most 65,536 rows per label, and about 15 million
    rows per bucket sort at 10^12 rows).
    """
    h = "_h"
    x = df.withColumn(h, _hex_order(seed, key)).withColumn("_b", F.substring(h, 1, bucket_hex))
    hist = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_b")
    offsets = (hist.withColumn("_off", F.sum("_n").over(w) - F.col("_n"))
               .withColumn(size_col, F.sum("_n").over(Window.partitionBy(label)))
               .drop("_n"))
    local = Window.partitionBy(label, "_b").orderBy(h, key)
    return (x.join(offsets, [label, "_b"])
            .withColumn(rank_col, F.col("_off") + F.row_number().over(local))
            .drop(h, "_b", "_off"))


def stratified_split(df: DataFrame, label: str = "winner", p: float = 0.8,
                     seed: str = "strat", key: str = "row_key",
                     part_col: str = "part") -> DataFrame:
    """First ceil(p * n_label) rows of each label in md5 order are 'train'."""
    r = rank_within_label(df, label, seed, key)
    # p as a fraction of whole numbers: a product of doubles can step over an integer
    share = Fraction(str(p))
    n_train = F.call_function("div", F.col("label_size") * share.numerator
                              + (share.denominator - 1), F.lit(share.denominator))
    return (r.withColumn(part_col, F.when(
        F.col("rank_in_label") <= n_train, F.lit("train"))
        .otherwise(F.lit("test"))).drop("rank_in_label", "label_size"))


def stratified_folds(df: DataFrame, label: str = "winner", k: int = 10,
                     seed: str = "folds", key: str = "row_key",
                     fold_col: str = "fold") -> DataFrame:
    """Deal rows of each label round-robin over k folds in md5 order.

    Every fold gets floor or ceil of n_label/k rows of each label.
    """
    r = rank_within_label(df, label, seed, key)
    return (r.withColumn(fold_col, ((F.col("rank_in_label") - 1) % k).cast("int"))
            .drop("rank_in_label", "label_size"))
