"""Multinomial Naive Bayes as one aggregation (fit) and one join (score).

Fitting is a single partial aggregate per (group, label): counts and feature
sums. The parameters are what ``pyspark.ml.classification.NaiveBayes``
(multinomial) computes:

    theta[c, j] = ln(S[c, j] + lambda) - ln(sum_j S[c, j] + lambda * d)
    pi[c]       = ln(n_c + lambda) - ln(N + lambda * K)

The fitted table has groups x labels rows (set by the number of splits and
classes, not by the data); scoring joins it, packed to one row per group.
Many models (one per split) are fitted in the same pass by putting the split
id in ``group_cols``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prescient.operators.split import of_split


def class_sums(train: DataFrame, feature_cols: list[str], label: str = "winner",
               group_cols: list[str] | None = None) -> DataFrame:
    """The sufficient statistics: one partial aggregate per (group, label).

    Rows without a label are not learned from, a null feature adds nothing, and
    a negative one is an error, as counts cannot be negative.
    """
    g = list(group_cols or [])

    def value(c):
        x = F.col(c).cast("double")
        return F.when(x < 0, F.raise_error(F.lit(f"naive Bayes: negative value of {c}"))) \
            .otherwise(x)

    return train.where(F.col(label).isNotNull()).groupBy(*g, label).agg(
        F.count(F.lit(1)).alias("n_c"),
        F.array(*[F.coalesce(F.sum(value(c)), F.lit(0.0)) for c in feature_cols]).alias("sums"))


def class_sums_by_bits(df: DataFrame, feature_cols: list[str], n_splits: int,
                       label: str = "winner", bits_col: str = "train_bits",
                       split_col: str = "test_set") -> DataFrame:
    """``class_sums`` of the training rows of every split, from rows that are stored
    once: one partial aggregate per (bits, label), which has at most 2^n_splits rows a
    label, is expanded to splits; the rows themselves are not."""
    sums = class_sums(df, feature_cols, label, [bits_col])
    parts = sums.select(
        bits_col, label, "n_c", *[F.col("sums")[i].alias(f"_s{i}") for i in range(len(feature_cols))])
    return of_split(parts, n_splits, True, bits_col, split_col).groupBy(split_col, label).agg(
        F.sum("n_c").alias("n_c"),
        F.array(*[F.sum(f"_s{i}") for i in range(len(feature_cols))]).alias("sums"))


def fold_sums(df: DataFrame, feature_cols: list[str], n_splits: int, label: str = "winner",
              bits_col: str = "train_bits", fold_col: str = "fold",
              split_col: str = "test_set") -> DataFrame:
    """``class_sums`` of the training part of every fold of every split: all folds'
    sums less the fold's own, from one partial aggregate per (bits, fold, label)."""
    names = [f"_s{i}" for i in range(len(feature_cols))]
    sums = class_sums(df, feature_cols, label, [bits_col, fold_col])
    parts = sums.select(bits_col, fold_col, label, "n_c",
                        *[F.col("sums")[i].alias(c) for i, c in enumerate(names)])
    per = of_split(parts, n_splits, True, bits_col, split_col) \
        .groupBy(split_col, fold_col, label).agg(*[F.sum(c).alias(c) for c in ("n_c", *names)])
    # Every fold meets every label of its split, also one that it has no row of.
    folds = per.groupBy(split_col).agg(F.collect_set(fold_col).alias("_folds"))
    total = per.groupBy(split_col, label).agg(*[F.sum(c).alias(f"t{c}") for c in ("n_c", *names)])
    every = total.join(folds, split_col).withColumn(fold_col, F.explode("_folds"))
    out = every.join(per, [split_col, fold_col, label], "left")

    def rest(c):
        return F.col(f"t{c}") - F.coalesce(F.col(c), F.lit(0))
    return out.select(split_col, fold_col, label, rest("n_c").alias("n_c"),
                      F.array(*[rest(c) for c in names]).alias("sums")).where("n_c > 0")


def params_from_sums(sums: DataFrame, d: int, label: str = "winner",
                     group_cols: list[str] | None = None, smoothing=1.0) -> DataFrame:
    """Parameters from ``class_sums``; ``smoothing`` is a number or a column
    (a grid of smoothing values then needs no second pass over the data)."""
    g = list(group_cols or [])
    lam = smoothing if isinstance(smoothing, Column) else F.lit(float(smoothing))
    total = F.aggregate("sums", F.lit(0.0), lambda a, v: a + v)
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    return (sums
            .withColumn("_tot", total)
            .withColumn("theta", F.transform(
                "sums", lambda v: F.log(v + lam) - F.log(F.col("_tot") + lam * d)))
            .withColumn("pi", F.log(F.col("n_c") + lam)
                        - F.log(F.sum("n_c").over(wg) + lam * F.count(F.lit(1)).over(wg)))
            # frequencyDesc order, ties alphabetical (as StringIndexer)
            .withColumn("label_idx", (F.row_number().over(
                wg.orderBy(F.desc("n_c"), F.col(label))) - 1).cast("int"))
            .select(*g, label, "label_idx", "n_c", "pi", "theta"))


def fit_params(train: DataFrame, feature_cols: list[str], label: str = "winner",
               group_cols: list[str] | None = None, smoothing: float = 1.0) -> DataFrame:
    """-> (group..., label, label_idx, n_c, pi, theta array<double>)."""
    sums = class_sums(train, feature_cols, label, group_cols)
    return params_from_sums(sums, len(feature_cols), label, group_cols, smoothing)


def importance(params: DataFrame, feature_cols: list[str], label: str = "winner",
               group_cols: list[str] | None = None) -> DataFrame:
    """Per feature: spread of its log-probability across classes, normalised
    to sum 1 (how strongly the feature separates the classes)."""
    g = list(group_cols or [])
    long = params_long(params, feature_cols, label, g)
    spread = long.groupBy(*g, "position", "feature").agg(
        (F.max("log_prob") - F.min("log_prob")).alias("_sp"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    return spread.withColumn("importance", F.col("_sp") / F.sum("_sp").over(wg)).drop("_sp")


def predict(df: DataFrame, params: DataFrame, feature_cols: list[str],
            label: str = "winner", group_cols: list[str] | None = None,
            out_col: str = "prediction", majority_col: str | None = None) -> DataFrame:
    """Add the argmax-posterior label; ties go to the lower label index.

    A row with a null feature has no score in any class and gets label index 0,
    the most frequent training label. Rows of a group without a model get null.
    ``majority_col`` also adds label index 0 of the row's group.

    The parameters are packed into one row per group (classes x features numbers)
    and broadcast: their size is that of the model, set by the number of groups,
    classes and features. The expression grows with the features alone.
    """
    g = list(group_cols or [])
    packed = params.groupBy(*g).agg(F.collect_list(
        F.struct("label_idx", F.col(label).alias("lbl"), "pi", "theta")).alias("_cls"))

    def score(p):
        # pi + (((0 + x0 t0) + x1 t1) + ...): the same order as the SQL oracle
        dot = F.lit(0.0)
        for i, c in enumerate(feature_cols):
            dot = dot + F.col(c).cast("double") * p["theta"][i]
        return F.struct((p["pi"] + dot).alias("s"), (-p["label_idx"]).alias("neg_idx"),
                        p["lbl"].alias("lbl"))

    # one model per group: equi-join; a single model: scalar subquery
    joined = df.join(F.broadcast(packed), g, "left") if g else \
        df.withColumn("_cls", packed.select("_cls").scalar())
    out = joined.withColumn(out_col, F.array_max(F.transform("_cls", score))["lbl"])
    if majority_col:
        out = out.withColumn(majority_col, F.array_min("_cls")["lbl"])
    return out.drop("_cls")


def params_long(params: DataFrame, feature_cols: list[str], label: str = "winner",
                group_cols: list[str] | None = None) -> DataFrame:
    """One row per (group, label, feature): log and plain conditional probability."""
    g = list(group_cols or [])
    names = F.array(*[F.lit(c) for c in feature_cols])
    return (params.select(*g, label, "n_c", "pi", F.posexplode(F.arrays_zip(names.alias("feature"),
                                                                      F.col("theta"))))
            .select(*g, label, "n_c", F.col("pos").alias("position"),
                    F.col("col.feature").alias("feature"),
                    F.col("col.theta").alias("log_prob"), "pi")
            .withColumn("prob", F.exp("log_prob")))
