"""Scoring, accuracy and the accuracy-over-time sweep.

The study re-filtered and re-scored the test rows once per cutoff (20 passes
per split and model, one process per cutoff). Here rows are scored once; the
sweep is one pass that tags each row with the smallest cutoff above its
frame and a partial aggregate per (group, cutoff bucket). Everything after
that aggregate runs on groups x cutoffs rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.functions.frames import first_cutoff_above


def correct_flag(label: str = "winner", prediction: str = "prediction"):
    return (F.col(prediction) == F.col(label)).cast("int")


def accuracy(preds: DataFrame, group_cols: list[str], label: str = "winner",
             prediction: str = "prediction") -> DataFrame:
    """Accuracy = matches / rows per group (MulticlassClassificationEvaluator 'accuracy')."""
    return (preds.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(correct_flag(label, prediction)).cast("bigint").alias("correct"))
            .withColumn("accuracy", F.col("correct") / F.col("n")))


def accuracy_wide(scored: DataFrame, classifiers: list[str], group_cols: list[str],
                  label: str = "winner") -> DataFrame:
    """``accuracy`` of several classifiers whose predictions are columns of one row:
    the rows are counted once, and only the groups become long rows."""
    return (_wide_counts(scored, classifiers, group_cols, label)
            .withColumn("accuracy", F.col("correct") / F.col("n")))


def _wide_counts(scored, classifiers, group_cols, label):
    counts = scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(correct_flag(label, c)), F.lit(0)).cast("bigint").alias(f"_correct_{c}")
          for c in classifiers])
    return counts.select(*group_cols, "n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("classifier"), F.col(f"_correct_{c}").alias("correct"))
        for c in classifiers])))


def confusion(preds: DataFrame, group_cols: list[str], label: str = "winner",
              prediction: str = "prediction") -> DataFrame:
    return (preds.groupBy(*group_cols, F.col(label).alias("label"),
                          F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def accuracy_curve(preds: DataFrame, cutoffs: list[int], group_cols: list[str],
                   frame: str = "frame", label: str = "winner",
                   prediction: str = "prediction") -> DataFrame:
    """Accuracy over rows with frame < cutoff, for every cutoff and group.

    Equal to the range join ``preds JOIN cutoffs ON frame < cutoff`` grouped
    by (group, cutoff). One pass over ``preds``: each row is counted once, in
    the bucket of the smallest cutoff above its frame. Each bucket total
    then adds to its own and every later cutoff — an expansion of the
    aggregated table (groups x cutoffs rows, at most cutoffs-fold), not of
    the data. Cutoffs below every frame of a group give no row, as in the join.
    """
    tagged = preds.withColumn("_cut", first_cutoff_above(frame, cutoffs))
    per_bucket = (tagged.where(F.col("_cut").isNotNull())
                  .groupBy(*group_cols, "_cut")
                  .agg(F.count(F.lit(1)).alias("_n"),
                       F.sum(correct_flag(label, prediction)).cast("bigint").alias("_c")))
    return _spread(per_bucket, cutoffs, group_cols)


def accuracy_curve_wide(scored: DataFrame, classifiers: list[str], cutoffs: list[int],
                        group_cols: list[str], frame: str = "frame",
                        label: str = "winner") -> DataFrame:
    """``accuracy_curve`` of several classifiers whose predictions are columns of one
    row: one aggregate over the rows, long rows for the (group, bucket) totals only."""
    tagged = scored.withColumn("_cut", first_cutoff_above(frame, cutoffs)) \
        .where(F.col("_cut").isNotNull())
    per_bucket = _wide_counts(tagged, classifiers, [*group_cols, "_cut"], label) \
        .withColumnsRenamed({"n": "_n", "correct": "_c"})
    return _spread(per_bucket, cutoffs, [*group_cols, "classifier"])


def _spread(per_bucket: DataFrame, cutoffs: list[int], group_cols: list[str]) -> DataFrame:
    """Totals of (group, smallest cutoff above) added to that and every later cutoff."""
    cut_arr = F.array(*[F.lit(int(c)) for c in sorted(cutoffs)])
    spread = per_bucket.withColumn("cutoff", F.explode(F.filter(cut_arr, lambda c: c >= F.col("_cut"))))
    return (spread.groupBy(*group_cols, "cutoff")
            .agg(F.sum("_n").cast("bigint").alias("n"), F.sum("_c").cast("bigint").alias("correct"))
            .withColumn("accuracy", F.col("correct") / F.col("n")))


def range_join_curve(preds: DataFrame, cutoffs_df: DataFrame, group_cols: list[str],
                     frame: str = "frame", label: str = "winner",
                     prediction: str = "prediction") -> DataFrame:
    """The direct form: theta join against the cutoff table.

    ``cutoffs_df`` has a size fixed by its parameter list, so it is
    broadcast and the join is a nested loop with no shuffle of ``preds``.
    Kept as the check for ``accuracy_curve`` and for irregular cutoff sets.
    """
    j = preds.join(F.broadcast(cutoffs_df), F.col(frame) < F.col("cutoff"))
    return accuracy(j, [*group_cols, "cutoff"], label, prediction)


def earliest_cutoff(curve: DataFrame, target: float, group_cols: list[str]) -> DataFrame:
    """Smallest cutoff whose accuracy reaches ``target`` per group."""
    return (curve.where(F.col("accuracy") >= F.lit(float(target)))
            .groupBy(*group_cols).agg(F.min("cutoff").alias("cutoff")))
