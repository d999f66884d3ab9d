"""Comparison of classifiers over repeated test sets.

Input: a long accuracy table (block, treatment, value) — here (test_set,
classifier, accuracy), optionally per cutoff (``by`` columns). All tests
run per ``by`` group; the tables involved have blocks x treatments rows per
group, set by the number of splits and classifiers, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prescient.functions.distributions import chi2_upper, shapiro_p, shapiro_w, t_two_sided_p


def block_ranks(acc: DataFrame, by: list[str], block: str = "test_set",
                treat: str = "classifier", value: str = "accuracy") -> DataFrame:
    """Rank treatments inside each block, ascending, ties get the average rank."""
    w = Window.partitionBy(*by, block).orderBy(value)
    ties = Window.partitionBy(*by, block, value)
    return acc.withColumn(
        "rank", F.rank().over(w).cast("double")
        + (F.count(F.lit(1)).over(ties).cast("double") - 1.0) / 2.0)


def friedman(acc: DataFrame, by: list[str], block: str = "test_set",
             treat: str = "classifier", value: str = "accuracy") -> DataFrame:
    """Friedman chi-square with tie correction, per ``by`` group.

    chi2 = (12 / (n k (k+1)) * sum R_j^2 - 3 n (k+1)) / (1 - sum(t^3 - t) / (n k (k^2 - 1)))
    """
    r = block_ranks(acc, by, block, treat, value)
    sums = r.groupBy(*by, treat).agg(F.sum("rank").alias("rank_sum"))
    ties = (r.groupBy(*by, block, value).agg(F.count(F.lit(1)).alias("t"))
            .groupBy(*by).agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_sum")))
    shape = r.groupBy(*by).agg(F.countDistinct(block).alias("n_blocks"),
                               F.countDistinct(treat).alias("k"))
    ss = sums.groupBy(*by).agg(F.sum(F.pow("rank_sum", 2)).alias("sum_r2"))
    n, k = F.col("n_blocks").cast("double"), F.col("k").cast("double")
    stat = ((F.lit(12.0) / (n * k * (k + 1)) * F.col("sum_r2") - 3.0 * n * (k + 1))
            / (F.lit(1.0) - F.col("tie_sum") / (n * k * (k * k - 1))))
    return (ss.join(ties, by).join(shape, by)
            .select(*by, "n_blocks", "k", stat.alias("statistic"),
                    (F.col("k") - 1).cast("int").alias("df")))


def friedman_pvalue(fr: DataFrame) -> DataFrame:
    return fr.withColumn("p_value", chi2_upper(F.col("statistic"), F.col("df")))


def paired_t(acc: DataFrame, by: list[str], block: str = "test_set",
             treat: str = "classifier", value: str = "accuracy") -> DataFrame:
    """Paired t statistic for every pair of treatments (t1 < t2) per group.

    Pairs are of treatments (k(k-1)/2 of them), matched by block; the join
    is on (by, block) between the k treatments of one block.
    """
    a = acc.select(*by, block, F.col(treat).alias("c1"), F.col(value).alias("v1"))
    b = acc.select(*by, block, F.col(treat).alias("c2"), F.col(value).alias("v2"))
    d = (a.join(b, [*by, block]).where(F.col("c1") < F.col("c2"))
         .withColumn("diff", F.col("v2") - F.col("v1")))
    g = d.groupBy(*by, "c1", "c2").agg(F.count(F.lit(1)).alias("n"),
                                       F.avg("diff").alias("mean_diff"),
                                       F.stddev_samp("diff").alias("sd_diff"))
    t = F.when(F.col("sd_diff") > 0,
               F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("n").cast("double"))))
    return g.withColumn("t", t).withColumn("df", (F.col("n") - 1).cast("int"))


def with_t_pvalue(pt: DataFrame) -> DataFrame:
    return pt.withColumn("p_value", t_two_sided_p("t", "df"))


def adjust(pv: DataFrame, by: list[str], method: str = "holm",
           p: str = "p_value", out: str = "p_adj", order_key: list[str] | None = None) -> DataFrame:
    """Holm step-down (default) or Bonferroni correction within each group.

    Holm: sort p ascending, p_(i) * (m - i + 1), running max, capped at 1.
    """
    m = F.count(F.col(p)).over(Window.partitionBy(*by))  # non-null p only
    if method == "bonferroni":
        return pv.withColumn(out, F.least(F.lit(1.0), F.col(p) * m))
    if method != "holm":
        raise ValueError(f"unknown method {method}")
    keys = [F.col(p).asc_nulls_last()] + [F.col(c) for c in (order_key or [])]
    w = Window.partitionBy(*by).orderBy(*keys)
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (pv.withColumn("_s", scaled)
            .withColumn(out, F.when(F.col(p).isNotNull(), F.max("_s").over(run)))
            .drop("_s"))


def normality(acc: DataFrame, by: list[str], value: str = "accuracy",
              alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk per group: w, p_value and normal (p over ``alpha``; false where there
    is no p). A group has a value for each test set, SMALL_GROUP at most."""
    x = F.array_sort(F.collect_list(F.col(value).cast("double")))
    return (acc.groupBy(*by).agg(x.alias("_x"))
            .select(*by, shapiro_w(F.col("_x")).alias("w"), F.size("_x").alias("_n"))
            .select(*by, "w", shapiro_p(F.col("w"), F.col("_n")).alias("p_value"))
            .withColumn("normal", F.coalesce(F.col("p_value") > alpha, F.lit(False))))
