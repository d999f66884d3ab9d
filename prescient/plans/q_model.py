"""Queries: Naive Bayes fit/score/interpretation, parameter grid, literal and
dimension tables, result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from prescient.operators import naive_bayes as nb
from prescient.operators import summary, sweep
from prescient.plans import inputs
from prescient.plans.oracle import (FEATS, MEASURES, NB_PARAMS, PREDICTIONS, SNAPSHOTS, SPLITS,
                                    with_)
from prescient.plans.q_sweep import measures
from prescient.plans.registry import query, r6
from prescient.session import scratch_path
from prescient.sources import sinks
from prescient.sources.snapshots import NUMERIC_FEATURES

_THETA_LONG = " UNION ALL ".join(
    f"SELECT test_set, winner, n_c, pi, {i} AS position, '{c}' AS feature, t{i} AS log_prob "
    f"FROM nb_params" for i, c in enumerate(FEATS))
NB_LONG = f"nb_long AS ({_THETA_LONG})"


def _params(spark, sf_dir):
    return inputs.nb_params(spark, sf_dir)


@query("train_nb_params", with_(SNAPSHOTS, SPLITS, NB_PARAMS, NB_LONG) + """
SELECT test_set, winner, n_c, round(pi, 6) AS pi, CAST(position AS INTEGER) AS position, feature,
       round(log_prob, 6) AS log_prob FROM nb_long""")
def train_nb_params(spark, sf_dir):
    """Multinomial NB for all five splits in one aggregation: priors and
    per-feature log probabilities."""
    long = nb.params_long(_params(spark, sf_dir), NUMERIC_FEATURES, group_cols=["test_set"])
    return long.select("test_set", "winner", "n_c", r6("pi").alias("pi"), "position", "feature",
                       r6("log_prob").alias("log_prob"))


@query("predict_nb", with_(SNAPSHOTS, PREDICTIONS) + """
SELECT row_key, test_set, prediction FROM predictions WHERE classifier = 'NB'""")
def predict_nb(spark, sf_dir):
    return nb.predict(inputs.test_rows(spark, sf_dir), _params(spark, sf_dir), NUMERIC_FEATURES,
                      group_cols=["test_set"]).select("row_key", "test_set", "prediction")


@query("nb_cond_prob", with_(SNAPSHOTS, SPLITS, NB_PARAMS, NB_LONG) + """
SELECT winner, feature, round(exp(log_prob), 6) AS prob FROM nb_long WHERE test_set = 1""")
def nb_cond_prob(spark, sf_dir):
    """Class-conditional probabilities (exp of the log table), split 1; each
    class column sums to 1."""
    long = nb.params_long(_params(spark, sf_dir).where(F.col("test_set") == 1),
                          NUMERIC_FEATURES, group_cols=["test_set"])
    return long.select("winner", "feature", r6("prob").alias("prob"))


@query("name_vector_slots", with_(SNAPSHOTS, SPLITS, NB_PARAMS, NB_LONG) + """
SELECT winner, CAST(position AS INTEGER) AS position, feature, round(log_prob, 6) AS log_prob
FROM nb_long WHERE test_set = 1""")
def name_vector_slots(spark, sf_dir):
    """Attach feature names to the slots of a fitted parameter vector by
    position (names come from the assembler's input list)."""
    p = _params(spark, sf_dir).where(F.col("test_set") == 1)
    slots = p.select("winner", F.posexplode("theta").alias("position", "log_prob"))
    names = spark.createDataFrame(list(enumerate(NUMERIC_FEATURES)), "position int, feature string")
    return (slots.join(F.broadcast(names), "position")
            .select("winner", "position", "feature", r6("log_prob").alias("log_prob")))


_IMPORTANCE = """
, sp AS (SELECT position, feature, max(log_prob) - min(log_prob) AS spread
         FROM nb_long WHERE test_set = 1 GROUP BY position, feature),
imp AS (SELECT position, feature, spread / sum(spread) OVER () AS importance FROM sp)"""


def _importance(spark, sf_dir):
    p = _params(spark, sf_dir).where(F.col("test_set") == 1)
    return nb.importance(p, NUMERIC_FEATURES, group_cols=["test_set"])


@query("importance_rank", with_(SNAPSHOTS, SPLITS, NB_PARAMS, NB_LONG) + _IMPORTANCE + """
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature,
       round(importance, 6) AS importance FROM imp""")
def importance_rank(spark, sf_dir):
    """Features ordered by importance (highest first)."""
    imp = _importance(spark, sf_dir)
    w = Window.orderBy(F.desc("importance"), "feature")
    return imp.select(F.row_number().over(w).cast("int").alias("rank"), "feature",
                      r6("importance").alias("importance"))


@query("importance_vs_reference", with_(SNAPSHOTS, SPLITS, NB_PARAMS, NB_LONG) + _IMPORTANCE + """
SELECT feature, round(importance, 6) AS importance,
       importance > (SELECT importance FROM imp WHERE feature = 'frame') AS above_reference
FROM imp""")
def importance_vs_reference(spark, sf_dir):
    """Is each feature more important than time ('frame') itself?"""
    imp = _importance(spark, sf_dir)
    # the reference row is read by a window over the (features-sized) table,
    # so the model is fitted once, not again inside a scalar subquery
    ref = F.max(F.when(F.col("feature") == "frame", F.col("importance"))).over(Window.partitionBy())
    return imp.select("feature", r6("importance").alias("importance"),
                      (F.col("importance") > ref).alias("above_reference"))


@query("expand_grid", with_(SNAPSHOTS, SPLITS) + f"""
, sums AS (SELECT test_set, winner, count(*) AS n_c,
                  {", ".join(f"sum(CAST({c} AS DOUBLE)) AS s{i}" for i, c in enumerate(FEATS))}
           FROM train GROUP BY test_set, winner),
grid AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS smoothing),
par AS (
  SELECT test_set, smoothing, winner,
         ln(n_c + smoothing) - ln(sum(n_c) OVER (PARTITION BY test_set, smoothing)
              + smoothing * count(*) OVER (PARTITION BY test_set, smoothing)) AS pi,
         row_number() OVER (PARTITION BY test_set, smoothing ORDER BY n_c DESC, winner) AS idx,
         {", ".join(f"ln(s{i} + smoothing) - ln(tot + smoothing * {len(FEATS)}) AS t{i}"
                    for i in range(len(FEATS)))}
  FROM (SELECT *, {" + ".join(f"s{i}" for i in range(len(FEATS)))} AS tot FROM sums) CROSS JOIN grid),
sc AS (
  SELECT x.row_key, x.test_set, p.smoothing, x.winner AS label, p.winner AS pred,
         row_number() OVER (PARTITION BY x.row_key, x.test_set, p.smoothing
           ORDER BY p.pi + ({" + ".join(f"x.{c} * p.t{i}" for i, c in enumerate(FEATS))}) DESC,
                    p.idx) AS rn
  FROM test x JOIN par p USING (test_set))
SELECT test_set, smoothing, count(*) AS n,
       CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM sc WHERE rn = 1 GROUP BY test_set, smoothing""")
def expand_grid(spark, sf_dir):
    """Grid (smoothing 0.5, 1, 2) x splits: every grid point's model from one
    pass of class sums, every test row scored for every grid point."""
    grid = (0.5, 1.0, 2.0)
    sums = inputs.nb_sums(spark, sf_dir)
    scored = inputs.test_rows(spark, sf_dir)
    for v in grid:
        params = nb.params_from_sums(sums, len(NUMERIC_FEATURES), group_cols=["test_set"],
                                     smoothing=v)
        scored = nb.predict(scored, params, NUMERIC_FEATURES, group_cols=["test_set"],
                            out_col=f"at{v}".replace(".", "_"))
    cols = [f"at{v}".replace(".", "_") for v in grid]
    value = F.create_map(*[F.lit(x) for c, v in zip(cols, grid, strict=True) for x in (c, v)])
    return sweep.accuracy_wide(scored, cols, ["test_set"]).select(
        "test_set", value[F.col("classifier")].alias("smoothing"), "n", "correct",
        r6("accuracy").alias("accuracy"))


# What each classifier of the prediction table is.
PARAMS_TEXT = [
    ("MAJ", "majority label of the training rows"),
    ("NB", "multinomial, smoothing = 1"),
    ("QTY", "quantity > 25"),
    ("TAX", "tax > 0.04"),
    ("PRICE", "price > 45000"),
    ("HASH", "md5 bucket of the row is odd"),
]
_PARAMS_VALUES = ", ".join(f"('{c}', '{t}')" for c, t in PARAMS_TEXT)


def _params_table(spark):
    return spark.createDataFrame(PARAMS_TEXT, "classifier string, params string")


@query("literal_table", with_(SNAPSHOTS, PREDICTIONS) + f"""
SELECT classifier, params FROM (VALUES {_PARAMS_VALUES}) AS t(classifier, params)
WHERE classifier IN (SELECT DISTINCT classifier FROM predictions)""")
def literal_table(spark, sf_dir):
    """A literal table with a declared schema, kept to the classifiers that
    scored rows (semi join against the data)."""
    # one row per classifier before the join, whatever the number of predictions
    present = inputs.predictions(spark, sf_dir).select("classifier").distinct()
    return _params_table(spark).join(present, "classifier", "left_semi")


@query("broadcast_dim_join", with_(SNAPSHOTS, MEASURES) + f"""
SELECT classifier, round(avg(accuracy), 6) AS accuracy, round(stddev_samp(accuracy), 6) AS sd, params
FROM curve JOIN (VALUES {_PARAMS_VALUES}) AS t(classifier, params) USING (classifier)
WHERE cutoff = (SELECT max(cutoff) FROM curve) GROUP BY classifier, params""")
def broadcast_dim_join(spark, sf_dir):
    """Results at the last cutoff with each classifier's parameter text
    (dimension side has one row per classifier: broadcast)."""
    m = measures(spark, sf_dir)
    last = m.where(F.col("cutoff") == m.agg(F.max("cutoff")).scalar())
    s = summary.location_spread(last, ["classifier"])
    return (s.join(F.broadcast(_params_table(spark)), "classifier")
            .select("classifier", r6("mean").alias("accuracy"), r6("sd").alias("sd"), "params"))


@query("single_file_sink", with_(SNAPSHOTS, MEASURES) + """
SELECT classifier, test_set, cutoff, n, correct, round(accuracy, 6) AS accuracy FROM curve""")
def single_file_sink(spark, sf_dir):
    """The measures written as one CSV file (overwrite), read back."""
    m = measures(spark, sf_dir).withColumn("accuracy", r6("accuracy"))
    path = scratch_path(spark, f"measures-{uuid.uuid4().hex[:12]}")
    sinks.write_single_csv(m, path)
    return spark.read.option("header", "true").schema(m.schema).csv(path)


@query("cutoff_from_path", with_(SNAPSHOTS, MEASURES) + """
SELECT cutoff, count(*) AS n_rows FROM curve GROUP BY cutoff""")
def cutoff_from_path(spark, sf_dir):
    """Measures written to one folder per cutoff ('measures_<cutoff>'); the
    cutoff is then parsed back out of each row's file path."""
    m = measures(spark, sf_dir).withColumn("folder", F.concat(F.lit("measures_"), "cutoff"))
    path = scratch_path(spark, f"measures-by-cutoff-{uuid.uuid4().hex[:12]}")
    sinks.write_csv(m.drop("cutoff"), path, partition_by=["folder"])
    back = spark.read.option("header", "true").schema(m.drop("cutoff", "folder").schema).csv(path)
    return (back.withColumn("cutoff", sinks.number_from_path())
            .groupBy("cutoff").agg(F.count(F.lit(1)).alias("n_rows")))

