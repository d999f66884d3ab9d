"""Queries over the measures (accuracy per classifier, test set, cutoff):
accuracy tables, summaries, reshaping, and the significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from prescient.functions.distributions import shapiro_weights, sql_normal_upper, sql_t_two_sided_p
from prescient.functions.frames import ADAPTER_CUTOFFS, FRAMES_PER_MINUTE, frames_to_minutes
from prescient.operators import significance as sig
from prescient.operators import prep, summary, sweep
from prescient.plans import inputs
from prescient.plans.inputs import CLASSIFIERS
from prescient.plans.oracle import DURATION, MEASURES, PREDICTIONS, SNAPSHOTS, with_
from prescient.plans.q_sweep import measures
from prescient.plans.registry import query, r6

PRED = with_(SNAPSHOTS, PREDICTIONS)
MEAS = with_(SNAPSHOTS, MEASURES)
BY = ["cutoff"]


# -- accuracy tables ---------------------------------------------------------

@query("accuracy_metric", PRED + """
SELECT classifier, count(*) AS n,
       CAST(sum(CASE WHEN prediction = winner THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(avg(CASE WHEN prediction = winner THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM predictions GROUP BY classifier""")
def accuracy_metric(spark, sf_dir):
    """matches / rows per classifier over every test row of every split."""
    acc = sweep.accuracy_wide(inputs.scored(spark, sf_dir), CLASSIFIERS, [])
    return acc.withColumn("accuracy", r6("accuracy"))


@query("accuracy_by_model", PRED + """
SELECT test_set, classifier, count(*) AS n,
       CAST(sum(CASE WHEN prediction = winner THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(avg(CASE WHEN prediction = winner THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM predictions GROUP BY test_set, classifier""")
def accuracy_by_model(spark, sf_dir):
    """One accuracy per (split, model): the study's accuracy table, long."""
    acc = sweep.accuracy_wide(inputs.scored(spark, sf_dir), CLASSIFIERS, ["test_set"])
    return acc.withColumn("accuracy", r6("accuracy"))


@query("confusion_matrix", PRED + """
SELECT classifier, winner AS label, prediction, count(*) AS n
FROM predictions GROUP BY classifier, winner, prediction""")
def confusion_matrix(spark, sf_dir):
    return sweep.confusion(inputs.predictions(spark, sf_dir), ["classifier"])


@query("range_join_cutoffs", MEAS + """
SELECT classifier, test_set, cutoff, n, correct, round(accuracy, 6) AS accuracy FROM curve""")
def range_join_cutoffs(spark, sf_dir):
    """The direct theta-join form of the sweep (cutoff table broadcast)."""
    preds = inputs.predictions(spark, sf_dir)
    cuts = spark.createDataFrame([(c,) for c in ADAPTER_CUTOFFS], "cutoff int")
    out = sweep.range_join_curve(preds, cuts, ["classifier", "test_set"])
    return out.withColumn("accuracy", r6("accuracy"))


_PIVOT_COLS = ",\n       ".join(
    f'max(CASE WHEN cutoff = {c} THEN round(accuracy, 6) END) AS "{c}"' for c in ADAPTER_CUTOFFS)


@query("accuracy_pivot_by_cutoff", MEAS + f"""
SELECT test_set, classifier,
       {_PIVOT_COLS}
FROM curve GROUP BY test_set, classifier""")
def accuracy_pivot_by_cutoff(spark, sf_dir):
    """One column per cutoff, named by the cutoff (the study's KNN table)."""
    m = measures(spark, sf_dir).withColumn("accuracy", r6("accuracy"))
    return summary.pivot_wide(m, ["test_set", "classifier"], "cutoff", ADAPTER_CUTOFFS, "accuracy")


_FIVE = [c for c in CLASSIFIERS if c != "HASH"]
_FIVE_COLS = ",\n       ".join(
    f"max(CASE WHEN classifier = '{c}' THEN round(accuracy, 6) END) AS {c}" for c in _FIVE)


@query("measures_join", MEAS + f"""
, wide AS (SELECT test_set, cutoff,
       {_FIVE_COLS}
  FROM curve WHERE classifier <> 'HASH' GROUP BY test_set, cutoff),
other AS (SELECT test_set, cutoff, round(accuracy, 6) AS HASH FROM curve WHERE classifier = 'HASH')
SELECT * FROM wide JOIN other USING (test_set, cutoff)""")
def measures_join(spark, sf_dir):
    """Wide table of five classifiers joined with a separately produced
    table of the sixth on the keys (test_set, cutoff), never by position."""
    m = measures(spark, sf_dir).withColumn("accuracy", r6("accuracy"))
    wide = summary.pivot_wide(m.where(F.col("classifier") != "HASH"), ["test_set", "cutoff"],
                              "classifier", _FIVE, "accuracy")
    other = (m.where(F.col("classifier") == "HASH")
             .select("test_set", "cutoff", F.col("accuracy").alias("HASH")))
    return wide.join(other, ["test_set", "cutoff"])


@query("unpivot_accuracy", MEAS + """
SELECT test_set, cutoff, classifier, round(accuracy, 6) AS accuracy FROM curve""")
def unpivot_accuracy(spark, sf_dir):
    """Wide (one column per classifier) back to long."""
    m = measures(spark, sf_dir).withColumn("accuracy", r6("accuracy"))
    wide = summary.pivot_wide(m, ["test_set", "cutoff"], "classifier", CLASSIFIERS, "accuracy")
    return summary.unpivot_long(wide, ["test_set", "cutoff"], CLASSIFIERS, "classifier", "accuracy")


# -- summaries ---------------------------------------------------------------

def _summary(spark, sf_dir):
    return summary.location_spread(measures(spark, sf_dir), ["cutoff", "classifier"])


@query("accuracy_mean", MEAS + """
SELECT cutoff, classifier, round(avg(accuracy), 6) AS mean FROM curve GROUP BY ALL""")
def accuracy_mean(spark, sf_dir):
    return _summary(spark, sf_dir).select("cutoff", "classifier", r6("mean").alias("mean"))


@query("accuracy_median", MEAS + """
SELECT cutoff, classifier, round(median(accuracy), 6) AS median FROM curve GROUP BY ALL""")
def accuracy_median(spark, sf_dir):
    return _summary(spark, sf_dir).select("cutoff", "classifier", r6("median").alias("median"))


@query("accuracy_sd", MEAS + """
SELECT cutoff, classifier, round(stddev_samp(accuracy), 6) AS sd FROM curve GROUP BY ALL""")
def accuracy_sd(spark, sf_dir):
    return _summary(spark, sf_dir).select("cutoff", "classifier", r6("sd").alias("sd"))


@query("accuracy_band", MEAS + """
SELECT cutoff, classifier, round(avg(accuracy) - stddev_samp(accuracy), 6) AS lower,
       round(avg(accuracy) + stddev_samp(accuracy), 6) AS upper FROM curve GROUP BY ALL""")
def accuracy_band(spark, sf_dir):
    b = summary.band(_summary(spark, sf_dir))
    return b.select("cutoff", "classifier", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("location_spread_join", MEAS + """
SELECT cutoff, classifier, round(avg(accuracy), 6) AS accuracy, round(stddev_samp(accuracy), 6) AS sd
FROM curve GROUP BY ALL""")
def location_spread_join(spark, sf_dir):
    """Location and spread per (cutoff, classifier): computed in one
    aggregation instead of two aggregations and a join."""
    s = _summary(spark, sf_dir)
    return s.select("cutoff", "classifier", r6("mean").alias("accuracy"), r6("sd").alias("sd"))


@query("subset_at_max_cutoff", MEAS + """
SELECT classifier, test_set, round(accuracy, 6) AS accuracy FROM curve
WHERE cutoff = (SELECT max(cutoff) FROM curve)""")
def subset_at_max_cutoff(spark, sf_dir):
    m = measures(spark, sf_dir)
    top = m.agg(F.max("cutoff")).scalar()
    return m.where(F.col("cutoff") == top).select("classifier", "test_set", r6("accuracy").alias("accuracy"))


@query("scalar_lookup", MEAS + """
SELECT round(accuracy, 6) AS accuracy FROM curve WHERE classifier = 'NB' AND cutoff = 1000
ORDER BY test_set LIMIT 1""")
def scalar_lookup(spark, sf_dir):
    """First matching value (NB, cutoff 1000, lowest test set)."""
    m = measures(spark, sf_dir)
    return (m.where((F.col("classifier") == "NB") & (F.col("cutoff") == 1000))
            .orderBy("test_set").limit(1).select(r6("accuracy").alias("accuracy")))


@query("earliest_reliable_cutoff", with_(SNAPSHOTS, MEASURES, DURATION) + f"""
, mc AS (SELECT classifier, cutoff, avg(accuracy) AS mean FROM curve GROUP BY ALL)
SELECT classifier, min(cutoff) AS cutoff,
       round(min(cutoff) / CAST({FRAMES_PER_MINUTE} AS DOUBLE), 6) AS minutes,
       round(min(cutoff) / (SELECT avg(duration) FROM snaps_d) * CAST(100 AS DOUBLE), 6) AS pct_mean_duration
FROM mc WHERE mean >= 0.5 GROUP BY classifier""")
def earliest_reliable_cutoff(spark, sf_dir):
    """Earliest cutoff whose mean accuracy reaches 0.5, in frames, minutes
    and percent of the (snapshot-weighted) mean duration."""
    s = _summary(spark, sf_dir).withColumnRenamed("mean", "accuracy")
    first = sweep.earliest_cutoff(s, 0.5, ["classifier"])
    mean_dur = prep.duration_summary(inputs.snapshots(spark, sf_dir)).select(
        "mean_duration_snapshots").scalar()
    return first.select("classifier", "cutoff", r6(frames_to_minutes("cutoff")).alias("minutes"),
                        r6(F.col("cutoff") / mean_dur * 100.0).alias("pct_mean_duration"))


@query("frames_to_minutes", with_(SNAPSHOTS, DURATION) + f"""
SELECT cutoff, round(cutoff / CAST({FRAMES_PER_MINUTE} AS DOUBLE), 6) AS minutes,
       round(cutoff / (SELECT avg(duration) FROM snaps_d) * CAST(100 AS DOUBLE), 6) AS pct_mean_duration
FROM (SELECT unnest([{", ".join(str(c) for c in ADAPTER_CUTOFFS[:-1])}]) AS cutoff
      UNION ALL SELECT max(frame) FROM snapshots)""")
def frames_to_minutes_q(spark, sf_dir):
    """Each cutoff (the last one = longest match) in minutes and as a share
    of the mean duration."""
    stats = prep.duration_summary(inputs.snapshots(spark, sf_dir)).select(
        F.col("max_duration").alias("mx"), F.col("mean_duration_snapshots").alias("md"))
    arr = F.concat(F.array(*[F.lit(c) for c in ADAPTER_CUTOFFS[:-1]]), F.array(F.col("mx")))
    return (stats.select(F.explode(arr).alias("cutoff"), "md")
            .select("cutoff", r6(frames_to_minutes("cutoff")).alias("minutes"),
                    r6(F.col("cutoff") / F.col("md") * 100.0).alias("pct_mean_duration")))


@query("all_true", MEAS + """
SELECT c.classifier, bool_and(c.accuracy >= m.accuracy) AS beats_majority
FROM curve c JOIN (SELECT test_set, cutoff, accuracy FROM curve WHERE classifier = 'MAJ') m
USING (test_set, cutoff) GROUP BY c.classifier""")
def all_true(spark, sf_dir):
    """Does each classifier match or beat the majority line in every test
    set and at every cutoff? (an all-aggregate of row flags)"""
    m = measures(spark, sf_dir)
    maj = m.where(F.col("classifier") == "MAJ").select("test_set", "cutoff",
                                                       F.col("accuracy").alias("maj"))
    return (m.join(maj, ["test_set", "cutoff"])
            .groupBy("classifier").agg(F.bool_and(F.col("accuracy") >= F.col("maj"))
                                       .alias("beats_majority")))


# -- significance -------------------------------------------------------------

@query("block_ranks", MEAS + """
SELECT test_set, classifier,
       CAST(rank() OVER (PARTITION BY test_set ORDER BY accuracy) AS DOUBLE)
       + (count(*) OVER (PARTITION BY test_set, accuracy) - 1) / CAST(2 AS DOUBLE) AS rank
FROM curve WHERE cutoff = (SELECT max(cutoff) FROM curve)""")
def block_ranks(spark, sf_dir):
    """Rank of each classifier inside each test set at the last cutoff."""
    m = measures(spark, sf_dir)
    last = m.where(F.col("cutoff") == m.agg(F.max("cutoff")).scalar())
    return sig.block_ranks(last, []).select("test_set", "classifier", "rank")


_FRIEDMAN = """
, rk AS (
  SELECT cutoff, test_set, classifier, accuracy,
         CAST(rank() OVER (PARTITION BY cutoff, test_set ORDER BY accuracy) AS DOUBLE)
         + (count(*) OVER (PARTITION BY cutoff, test_set, accuracy) - 1) / CAST(2 AS DOUBLE) AS rank
  FROM curve),
rs AS (SELECT cutoff, classifier, sum(rank) AS rank_sum FROM rk GROUP BY ALL),
ts AS (SELECT cutoff, sum(t * t * t - t) AS tie_sum FROM
        (SELECT cutoff, test_set, accuracy, count(*) AS t FROM rk GROUP BY ALL) GROUP BY cutoff),
sh AS (SELECT cutoff, count(DISTINCT test_set) AS n_blocks, count(DISTINCT classifier) AS k
       FROM rk GROUP BY cutoff),
fr AS (
  SELECT cutoff, n_blocks, k,
         (CAST(12 AS DOUBLE) / (n_blocks * k * (k + 1)) * sum_r2 - CAST(3 AS DOUBLE) * n_blocks * (k + 1))
         / (CAST(1 AS DOUBLE) - tie_sum / (n_blocks * k * (k * k - 1))) AS statistic,
         CAST(k - 1 AS INTEGER) AS df
  FROM (SELECT cutoff, sum(rank_sum * rank_sum) AS sum_r2 FROM rs GROUP BY cutoff)
  JOIN ts USING (cutoff) JOIN sh USING (cutoff))"""


@query("friedman_statistic", MEAS + _FRIEDMAN + """
SELECT cutoff, n_blocks, k, round(statistic, 6) AS statistic, df FROM fr""")
def friedman_statistic(spark, sf_dir):
    fr = sig.friedman(measures(spark, sf_dir), BY)
    return fr.withColumn("statistic", r6("statistic"))


@query("friedman_pvalue", MEAS + _FRIEDMAN + """
SELECT cutoff, round(statistic, 6) AS statistic, df,
       round(CASE WHEN statistic <= 0 THEN 1.0 ELSE 1.0 - list_sum(list_transform(range(0, 400),
         lambda i: exp((df / 2.0 + i) * ln(greatest(statistic, 1e-300) / 2) - statistic / 2
                       - lgamma(df / 2.0 + i + 1)))) END, 8) AS p_value
FROM fr""")
def friedman_pvalue(spark, sf_dir):
    """Chi-square tail of the Friedman statistic."""
    fr = sig.friedman_pvalue(sig.friedman(measures(spark, sf_dir), BY))
    return fr.select("cutoff", r6("statistic").alias("statistic"), "df",
                     F.round("p_value", 8).alias("p_value"))


_PAIRS = """
, pairs AS (
  SELECT a.cutoff, a.classifier AS c1, b.classifier AS c2, count(*) AS n,
         avg(b.accuracy - a.accuracy) AS mean_diff, stddev_samp(b.accuracy - a.accuracy) AS sd_diff
  FROM curve a JOIN curve b
    ON a.cutoff = b.cutoff AND a.test_set = b.test_set AND a.classifier < b.classifier
  GROUP BY ALL),
tt AS (SELECT *, CASE WHEN sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n)) END AS t,
              CAST(n - 1 AS INTEGER) AS df FROM pairs)""" + f""",
pv AS (SELECT *, {sql_t_two_sided_p("t", "df")} AS p_value FROM tt)"""


def _pvalues(spark, sf_dir):
    return sig.with_t_pvalue(sig.paired_t(measures(spark, sf_dir), BY))


@query("paired_t_statistic", MEAS + _PAIRS + """
SELECT cutoff, c1, c2, n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, df FROM tt""")
def paired_t_statistic(spark, sf_dir):
    pt = sig.paired_t(measures(spark, sf_dir), BY)
    return pt.select("cutoff", "c1", "c2", "n", r6("mean_diff").alias("mean_diff"),
                     r6("t").alias("t"), "df")


@query("paired_t_pvalue", MEAS + _PAIRS + """
SELECT cutoff, c1, c2, round(t, 6) AS t, df, round(p_value, 6) AS p_value FROM pv""")
def paired_t_pvalue(spark, sf_dir):
    """Two-sided p of the paired t (closed form for integer df, JVM-side)."""
    pv = _pvalues(spark, sf_dir)
    return pv.select("cutoff", "c1", "c2", r6("t").alias("t"), "df",
                     r6("p_value").alias("p_value"))


_HOLM = """
, ho AS (
  SELECT *, least(CAST(1 AS DOUBLE), p_value * (count(p_value) OVER (PARTITION BY cutoff)
            - row_number() OVER (PARTITION BY cutoff ORDER BY p_value NULLS LAST, c1, c2) + 1)) AS s
  FROM pv),
holm AS (
  SELECT cutoff, c1, c2, p_value,
         CASE WHEN p_value IS NULL THEN NULL ELSE
           max(s) OVER (PARTITION BY cutoff ORDER BY p_value NULLS LAST, c1, c2
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS p_adj
  FROM ho)"""


def _adjusted(spark, sf_dir, method):
    return sig.adjust(_pvalues(spark, sf_dir), BY, method, order_key=["c1", "c2"])


@query("holm_adjust", MEAS + _PAIRS + _HOLM + """
SELECT cutoff, c1, c2, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj FROM holm""")
def holm_adjust(spark, sf_dir):
    a = _adjusted(spark, sf_dir, "holm")
    return a.select("cutoff", "c1", "c2", r6("p_value").alias("p_value"), r6("p_adj").alias("p_adj"))


@query("bonferroni_adjust", MEAS + _PAIRS + """
SELECT cutoff, c1, c2, round(p_value, 6) AS p_value,
       round(least(CAST(1 AS DOUBLE), p_value * count(p_value) OVER (PARTITION BY cutoff)), 6) AS p_adj FROM pv""")
def bonferroni_adjust(spark, sf_dir):
    a = _adjusted(spark, sf_dir, "bonferroni")
    return a.select("cutoff", "c1", "c2", r6("p_value").alias("p_value"), r6("p_adj").alias("p_adj"))


_ROW_LABELS = sorted(CLASSIFIERS)[1:]
_COL_LABELS = sorted(CLASSIFIERS)[:-1]
_MATRIX_COLS = ",\n       ".join(
    f"max(CASE WHEN c1 = '{c}' THEN round(p_adj, 6) END) AS {c}" for c in _COL_LABELS)


@query("pvalue_matrix", MEAS + _PAIRS + _HOLM + f"""
SELECT cutoff, c2 AS classifier,
       {_MATRIX_COLS}
FROM holm GROUP BY cutoff, c2""")
def pvalue_matrix(spark, sf_dir):
    """Lower-triangular matrix of Holm-adjusted p: a row per second
    classifier, a column per first classifier, per cutoff."""
    a = _adjusted(spark, sf_dir, "holm").withColumn("p_adj", r6("p_adj"))
    return (summary.pivot_wide(a, ["cutoff", "c2"], "c1", _COL_LABELS, "p_adj")
            .withColumnRenamed("c2", "classifier"))


_SW_Z = """(-ln((-2.273 + 0.459 * n) - ln(1 - w)) - (0.544 - 0.39978 * n + 0.025054 * n * n
         - 6.714e-4 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)"""
_NORMAL = f"""
, xs AS (SELECT cutoff, classifier, list(accuracy ORDER BY accuracy) AS x, count(*) AS n,
           avg(accuracy) AS m FROM curve GROUP BY ALL),
sw AS (SELECT *, CASE WHEN n < 3 OR x[n] = x[1] THEN NULL ELSE least(1.0,
         pow(list_sum(list_transform(range(1, n // 2 + 1), lambda i: a[i] * (x[n + 1 - i] - x[i]))), 2)
         / list_sum(list_transform(x, lambda v: (v - m) * (v - m)))) END AS w
       FROM (SELECT *, CASE n {" ".join(f"WHEN {n} THEN {shapiro_weights(n)}" for n in (3, 4, 5))} END
               AS a FROM xs)),
zs AS (SELECT *, CASE WHEN w < 1 AND n > 3 THEN {_SW_Z} END AS z FROM sw),
normal AS (SELECT cutoff, classifier, w, CASE WHEN w IS NULL THEN NULL
    WHEN n = 3 THEN greatest(0.0, least(1.0, 6 / pi() * (asin(sqrt(w)) - pi() / 3)))
    WHEN w >= 1 THEN 1.0 WHEN ln(1 - w) >= -2.273 + 0.459 * n THEN 1e-99
    ELSE {sql_normal_upper("z")} END AS p FROM zs)"""


@query("normality_flags", MEAS + _NORMAL + """
SELECT cutoff, classifier, round(w, 6) AS w, round(p, 6) AS p_value, coalesce(p > 0.05, false) AS normal
FROM normal""")
def normality_flags(spark, sf_dir):
    """Shapiro-Wilk p per (cutoff, classifier) over the test sets; normal if p > 0.05."""
    flags = sig.normality(measures(spark, sf_dir), ["cutoff", "classifier"])
    return flags.withColumn("w", r6("w")).withColumn("p_value", r6("p_value"))


@query("robust_location", MEAS + _NORMAL + """
, every AS (SELECT bool_and(coalesce(p > 0.05, false)) AS all_normal FROM normal)
SELECT cutoff, classifier, all_normal,
       round(CASE WHEN all_normal THEN avg(accuracy) ELSE median(accuracy) END, 6) AS accuracy,
       round(stddev_samp(accuracy), 6) AS sd
FROM curve, every GROUP BY cutoff, classifier, all_normal""")
def robust_location(spark, sf_dir):
    """Mean if every (cutoff, classifier) group looks normal, else median; with sd."""
    m = measures(spark, sf_dir)
    flags = sig.normality(m, ["cutoff", "classifier"])
    s = summary.location_spread(m, ["cutoff", "classifier"])
    return summary.robust_location(s, flags).select(
        "cutoff", "classifier", "all_normal", r6("location").alias("accuracy"), r6("sd").alias("sd"))
