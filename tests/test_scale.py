"""Faults that larger tables showed: each test failed before its mending."""

import glob
import time
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SMALL
from prescient.operators import features as fe
from prescient.operators import knn, split, svm, tuning
from prescient.operators import learners as L
from prescient.plans import inputs, load_all
from prescient.session import ready, scratch_path
from prescient.sources import sinks


def test_threads_that_ask_for_one_table_share_it(spark, tmp_path):
    """the second writer deleted the files that the first one's reader held."""
    built = []

    def ask(i):
        time.sleep(0.3 * i)
        rows = sinks.materialize_once(spark, f"{tmp_path}/table", build, key="k")
        time.sleep(2.0)
        return rows.agg(F.sum("id")).first()[0]

    def build():
        built.append(1)
        time.sleep(1.0)
        return spark.range(1000)
    with ThreadPool(3) as pool:
        assert pool.map(ask, range(3), chunksize=1) == [499500] * 3
    assert len(built) == 1


def planted(spark, n=900):
    """Two classes that no line parts, of three inputs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] ** 2 + x[:, 1] + 0.3 * rng.normal(size=n)) > 0.5).astype(float)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)],
                                 ["scaled", L.LABEL])
    return rows.repartition(5).cache()


def test_machines_fitted_together_are_those_of_the_library(spark):
    """Coefficients of LinearSVC, without holding expanded rows."""
    ready(spark)
    rows, n = planted(spark), 900
    poly, fourier = svm.Polynomial(3, 2), svm.Fourier(3, 16, 1.5)
    weight = np.sqrt(0.1) ** poly.degrees
    wide = PolynomialExpansion(inputCol="scaled", outputCol="poly", degree=2).transform(
        rows.withColumn("scaled", array_to_vector(
            F.transform(vector_to_array("scaled"), lambda v: v * float(np.sqrt(0.1))))))
    cases = [(svm.Machine(svm.Plain(3), None, 0.5 / n, 5), "scaled", rows),
             (svm.Machine(poly, weight, 1.0 / n, 60), "poly", wide),
             (svm.Machine(poly, np.where(poly.degrees < 2, weight, 0.0), 1.0 / n, 60), "line",
              rows.withColumn("line", array_to_vector(F.transform(
                  vector_to_array("scaled"), lambda v: v * float(np.sqrt(0.1)))))),
             (svm.Machine(fourier, None, 1.0 / n, 60), "rff",
              L.random_fourier(rows, "scaled", "rff", 16, 3, 1.5))]
    models = svm.fit_together(rows, [m for m, *_ in cases], "scaled", L.LABEL)
    scored = svm.predict(rows, models, "scaled", ["a", "b", "c", "d"])
    for c, model, (machine, col, df) in zip("abcd", models, cases, strict=True):
        one = LinearSVC(labelCol=L.LABEL, featuresCol=col, regParam=machine.reg,
                        maxIter=machine.rounds, standardization=False).fit(df)
        assert model.intercept == pytest.approx(one.intercept, abs=1e-9)
        want = one.transform(df).agg(F.sum("prediction")).first()[0]
        assert scored.agg(F.sum(c)).first()[0] == want
    x = np.array([r.scaled.toArray() for r in rows.collect()])
    got = models[1].coefficients @ poly(x.T)
    full = LinearSVC(labelCol=L.LABEL, featuresCol="poly", regParam=1.0 / n, maxIter=60,
                     standardization=False).fit(wide)
    raw = [r.poly.toArray() @ full.coefficients.toArray() for r in wide.collect()]
    assert np.allclose(got * 1.0, raw, atol=1e-8)


def test_grids_of_machines_write_no_expanded_rows(spark, monkeypatch):
    """The written vectors are the inputs, 36 points are fitted in shared passes."""
    written, passes = [], []
    monkeypatch.setattr(tuning, "write_parts", lambda *a, f=tuning.write_parts: written.append(
        f(*a)) or written[-1])
    monkeypatch.setattr(svm, "_losses", lambda *a, f=svm._losses: passes.append(1) or f(*a))
    rows = load_all()[0]["grid_svm_poly"](spark, SMALL).collect()
    assert len(rows) == 36 and all(r.folds == 3 for r in rows)
    assert all(set(df.columns) == {L.LABEL, L.FEAT, "scaled"} for _, *parts in written for df in parts)
    assert len(passes) < 36 * 3


def test_few_pairs_are_measured_and_all_neighbours_found():
    """ties, copies and far-off vectors as by all distances."""
    rng = np.random.default_rng(0)
    for dim, far in ((3, 0.0), (64, 1e7)):
        t = np.round(rng.normal(size=(700, dim)), 1 if dim == 3 else 8) + far
        t = np.vstack([t, t[:200]])
        q = np.vstack([t[50:90], rng.normal(size=(300, dim)) + far])
        by_id = rng.permutation(len(t))
        d = knn._dist_rows(q, t)
        want = [np.lexsort((by_id, d[i]))[:5] for i in range(len(q))]
        i, j, dist = knn._near(q, t, by_id, 5, chunk=64)
        assert (i == np.repeat(np.arange(len(q)), 5)).all()
        assert (j == np.concatenate(want)).all()
        assert np.allclose(dist, d[i, j], rtol=1e-12, atol=0)


def test_matrix_product_meets_the_pairs(monkeypatch):
    """distances from differences only of what the bound leaves."""
    made = []
    monkeypatch.setattr(np, "einsum", lambda s, *a, f=np.einsum: made.append(a[0].size) or f(s, *a))
    rng = np.random.default_rng(0)
    q, t = rng.normal(size=(500, 16)), rng.normal(size=(1000, 16))
    knn._near(q, t, np.arange(1000), 3)
    assert sum(made) < q.shape[0] * t.shape[0] * 16 / 50


def test_sorted_chunks_hold_some_rows(spark):
    """Every row once, sorted by chunk, with nulls first; no sort of a partition."""
    df = spark.range(1000).coalesce(1).select(
        F.when(F.col("id") % 10 != 3, F.col("id") * 7 % 101).alias("frame"), F.col("id").alias("x"))
    got = [(r.frame, r.x) for r in split.sorted_chunks(df, "frame", 1 << 18).collect()]
    assert got == [(r.frame, r.x) for r in df.sortWithinPartitions("frame", "x").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        some = [(r.frame, r.x) for r in split.sorted_chunks(df, "frame", 300).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(some, key=lambda r: r[1]) == sorted(got, key=lambda r: r[1])
    assert all(a[0] is None or a[0] <= b[0] for a, b in zip(some[:299], some[1:300], strict=True)
               if b[0] is not None)
    build = inputs.split_table(spark, SMALL)
    assert build.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_forest_of_groups_is_one_forest(spark, monkeypatch):
    """the trees of all groups, no more than some weights held in a fit."""
    assert L.forest_groups(25_000_000, 150) == [10] * 15
    assert L.forest_groups(1000, 150) == [150] and L.forest_groups(10**12, 3) == [1, 1, 1]
    df = spark.range(900).select(
        F.concat(F.lit("r"), "id").alias("row_key"), (F.col("id") % 50).cast("int").alias("frame"),
        (F.col("id") * 7919 % 101).cast("double").alias("quantity"),
        *[(F.col("id") * p % 13).cast("double").alias(c) for p, c in enumerate(
            ("price", "discount", "tax", "linenumber", "enemy_quantity", "enemy_price"), 3)],
        F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("races")) \
        .withColumn("winner", F.when(F.col("quantity") > 50, "O").otherwise("F"))
    whole = L.fit_forest(L.rf(4).setNumTrees(12), df)
    same = L.fit(L.pipeline(L.rf(4).setNumTrees(12)), df)
    assert whole.stages[-1].toDebugString.split("\n")[1:] == same.stages[-1].toDebugString.split("\n")[1:]
    monkeypatch.setattr(L, "FOREST_WEIGHTS", 900 * 5)
    parts = L.fit_forest(L.rf(4).setNumTrees(12), df)
    forest = parts.stages[-1]
    assert forest.getNumTrees == 12 and len({t.toDebugString for t in forest.trees}) > 6
    imp = {r["feature"]: r["importance"] for r in L.importances(parts, fe.MODEL_INPUTS).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and max(imp, key=imp.get) == "quantity"
    got = L.predictions(parts, df, "RF", ["row_key", "winner"])
    assert got.where("prediction = winner").count() > 850


def test_large_fits_run_alone():
    """fits beside a large one only push its rows to disk."""
    assert tuning.at_once(1000, 4) == 4 and tuning.at_once(0, 3) == 3
    assert tuning.at_once(2_500_000, 8) == 4 and tuning.at_once(25_000_000, 4) == 1


class Seen:
    """An estimator that counts the rows of the tasks it is given."""

    def fit(self, rows):
        self.tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        self.ids = rows.agg(F.count("id"), F.sum("id")).first()
        return self


def test_rows_of_one_row_group_are_dealt_over_the_cluster(spark):
    """a scan gives a row group to one task, which did every pass of a fit alone."""
    n = 140_000
    rows = spark.range(0, n, 1, 1).withColumn("id", F.col("id") % 70_000)
    seen = L.fit(Seen(), rows)
    assert len(seen.tasks) >= 4 and max(seen.tasks) <= 2 * n / len(seen.tasks)
    assert tuple(seen.ids) == (n, 2 * sum(range(70_000)))


def test_small_or_even_rows_are_not_dealt_anew(spark):
    assert L.fit(Seen(), spark.range(0, 40_000, 1, 1)).tasks == [40_000]
    assert L.fit(Seen(), spark.range(0, 280_000, 1, 4)).tasks == [70_000] * 4
    assert L.fit(Seen(), spark.range(0)).tasks == []
    assert L.dealt_tasks(3_000_000, 100_000_000, 12) == 0
    assert L.dealt_tasks(36_000_000, 36_000_000, 12) == 35
    assert L.dealt_tasks(420_000, 420_000, 4_000) == 26


def test_learners_hold_what_they_read_and_score_in_many_tasks(spark, monkeypatch):
    """row keys and match ids were held for each fit; one task scored a row group."""
    held, fit = [], L.fit

    def recorded(estimator, train):
        held.append(train.columns)
        return fit(estimator, train)
    monkeypatch.setattr(L, "fit", recorded)
    whole = load_all()[0]["train_lr"](spark, SMALL)
    monkeypatch.setattr(L, "ROWS_UNEVEN", 100)
    monkeypatch.setattr(L, "ROWS_DEALT", 500)
    dealt = load_all()[0]["train_lr"](spark, SMALL)
    assert held == [fe.columns()] * 2
    assert dealt.rdd.getNumPartitions() == 4
    assert sorted(r.row_key for r in dealt.collect()) == sorted(r.row_key for r in whole.collect())


def test_trees_that_do_not_fit_together_are_fitted_in_small_groups():
    """99 trees of 2.5 million rows in a fit took 3.1 s each, 30 of them 1.2 s."""
    assert L.forest_groups(2_520_000, 150) == [30] * 5
    assert L.forest_groups(1_600_000, 150) == [150] and L.forest_groups(25_000_000, 7) == [7]


def test_rows_of_a_large_forest_are_dealt_evenly(spark):
    """a cluster waited for the task of the largest row group at each level."""
    rows = spark.range(0, 9000, 1, 3)
    got = [r["count"] for r in L.evened(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(got) == 4 and sum(got) == 9000 and max(got) <= 2400
    even = spark.range(0, 9000, 1, 4)
    assert L.evened(even) is even and L.evened(spark.range(0)).count() == 0


def test_second_round_emits_what_is_within_the_bound():
    """each visited block emitted k candidates a query, most of them too far."""
    tdf = pd.DataFrame({"t_id": [1, 2, 3], "tv": [[0.0], [1.0], [2.0]]})
    qdf = pd.DataFrame({"q_id": [7, 8, 9], "qv": [[0.0], [0.0], [0.0]], "r": [1.0, np.inf, 0.5]})
    fn = knn._block_topk(3, "qv", "tv", False)
    got = fn(None, qdf, tdf)
    assert sorted(zip(got.q_id, got.t_id)) == [(7, 1), (7, 2), (8, 1), (8, 2), (8, 3), (9, 1)]
    assert len(fn(None, qdf.assign(r=-1.0), tdf)) == 0
    assert len(fn(None, qdf.drop(columns="r"), tdf)) == 9


def test_steps_of_the_neighbour_search_go_when_they_were_read(spark):
    """seven copies of the rows stayed on disk until the session's end."""
    ready(spark)
    def steps():
        return set(glob.glob(f"{scratch_path(spark, 'knn-').removeprefix('file://')}*"))
    before = steps()
    rows = spark.createDataFrame([(i, [float(i % 37), float(i % 11)]) for i in range(400)],
                                 "vec_id int, embedding array<double>")
    near = knn.nearest(rows.where("vec_id % 3 = 0"), rows, 2, label_col=None, n_cells=5)
    assert len(steps() - before) == 3  # the dealt index, the first round, the dealt visits
    assert near.count() == 2 * 134
