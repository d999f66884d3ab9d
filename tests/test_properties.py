"""Properties of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from prescient.functions.frames import ADAPTER_CUTOFFS
from prescient.operators import knn, split, sweep
from prescient.operators import naive_bayes as nb
from prescient.plans import inputs
from prescient.sources import sinks
from prescient.sources.snapshots import NUMERIC_FEATURES


@pytest.fixture(scope="module")
def preds(spark):
    return inputs.predictions(spark, SMALL).cache()


def test_sweep_equals_range_join(spark, preds):
    g = ["classifier", "test_set"]
    a = sweep.accuracy_curve(preds, ADAPTER_CUTOFFS, g)
    cuts = spark.createDataFrame([(c,) for c in ADAPTER_CUTOFFS], "cutoff int")
    b = sweep.range_join_curve(preds, cuts, g)
    cols = g + ["cutoff", "n", "correct"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_sweep_irregular_cutoffs(spark, preds):
    g = ["classifier"]
    cutoffs = [7, 300, 301, 1999, 5000]
    a = sweep.accuracy_curve(preds, cutoffs, g)
    b = sweep.range_join_curve(preds, spark.createDataFrame([(c,) for c in cutoffs], "cutoff int"), g)
    cols = g + ["cutoff", "n", "correct"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_last_cutoff_is_unfiltered_accuracy(preds):
    c = sweep.accuracy_curve(preds, ADAPTER_CUTOFFS, ["classifier"])
    last = {r["classifier"]: (r["n"], r["correct"])
            for r in c.where(F.col("cutoff") == max(ADAPTER_CUTOFFS)).collect()}
    full = {r["classifier"]: (r["n"], r["correct"])
            for r in sweep.accuracy(preds, ["classifier"]).collect()}
    assert last == full


def test_split_partition_independent(spark):
    s = inputs.snapshots(spark, SMALL)
    a = split.hash_split(s.repartition(3), 1).select("row_key", "part")
    b = split.hash_split(s.repartition(11), 1).select("row_key", "part")
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.where(F.col("part") == "train").count() / a.count()
    assert 0.65 < share < 0.75


def test_stratified_folds_balanced(spark):
    s = inputs.snapshots(spark, SMALL).select("row_key", "winner")
    f = split.stratified_folds(s, "winner", 10, "t")
    assert f.count() == s.count()
    assert f.select("row_key").distinct().count() == s.count()
    sizes = f.groupBy("winner", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["winner"], []).append(r["count"])
    for v in by_label.values():
        assert len(v) == 10 and max(v) - min(v) <= 1


def test_stratified_split_exact(spark):
    s = inputs.snapshots(spark, SMALL).select("row_key", "winner")
    out = split.stratified_split(s, "winner", 0.8, "x")
    for r in out.groupBy("winner").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum((F.col("part") == "train").cast("int")).alias("t")
                                       ).collect():
        assert r["t"] == -(-r["n"] * 8 // 10)


def test_nb_matches_pyspark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    s = inputs.snapshots(spark, SMALL)
    params = {r["winner"]: r for r in nb.fit_params(s, NUMERIC_FEATURES).collect()}
    ix = StringIndexer(inputCol="winner", outputCol="y").fit(s)
    data = VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="x").transform(ix.transform(s))
    m = NaiveBayes(featuresCol="x", labelCol="y", smoothing=1.0).fit(data)
    theta = m.theta.toArray()
    for i, lab in enumerate(ix.labels):
        assert np.allclose(theta[i], params[lab]["theta"], rtol=1e-9)
        assert m.pi.toArray()[i] == pytest.approx(params[lab]["pi"], rel=1e-9)
        assert params[lab]["label_idx"] == i
    # each class's conditional probabilities sum to 1
    long = nb.params_long(nb.fit_params(s, NUMERIC_FEATURES), NUMERIC_FEATURES)
    for r in long.groupBy("winner").agg(F.sum("prob").alias("p")).collect():
        assert r["p"] == pytest.approx(1.0, abs=1e-9)


def _planted_vectors(spark, n_train=400, n_test=100, dim=8):
    # arithmetic, seeded: integer grid values give exact distance ties; the
    # first 20 train rows repeat rows 20..39 (duplicates)
    def vec(i, salt):
        return [float(((i * 7919 + j * 104729 + salt) % 23) // 4) for j in range(dim)]
    train = [(i, vec(i % 380 + (20 if i < 20 else 0), 1), i % 4) for i in range(n_train)]
    test = [(10000 + i, vec(i, 5), i % 4) for i in range(n_test)]
    schema = "vec_id long, embedding array<double>, label int"
    return spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), train, test


def _brute(train, test, k):
    t_ids = np.array([r[0] for r in train])
    tv = np.array([r[1] for r in train])
    out = {}
    for q in test:
        d = np.sqrt(((tv - np.array(q[1])) ** 2).sum(axis=1))
        order = np.lexsort((t_ids, d))[:k]
        out[q[0]] = [int(t_ids[i]) for i in order]
    return out


@pytest.mark.parametrize("n_cells,block_rows", [(1, 2048), (6, 2048), (6, 37), (25, 16)])
def test_knn_exact_with_ties(spark, n_cells, block_rows):
    tdf, qdf, train, test = _planted_vectors(spark)
    nn = knn.nearest(qdf, tdf, 5, n_cells=n_cells, block_rows=block_rows)
    got = {}
    for r in nn.orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["t_id"])
    assert got == _brute(train, test, 5)


def test_knn_vote_ties_go_to_nearest(spark):
    rows = [(1, 1, 0, 1.0, 1), (1, 2, 1, 2.0, 2), (1, 3, 2, 3.0, 3)]
    df = spark.createDataFrame(rows, "q_id long, t_id long, t_label int, dist double, rank int")
    assert knn.vote(df, 3).collect()[0]["prediction"] == 0


def test_optimal_weights_sum_to_one():
    for k in (3, 5, 13):
        assert sum(knn.optimal_weights(k, 64).values()) == pytest.approx(1.0)


def test_materialize_once(spark, tmp_path):
    path = str(tmp_path / "t")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10)
    a = sinks.materialize_once(spark, path, build)
    b = sinks.materialize_once(spark, path, build)
    assert a.count() == b.count() == 10 and len(calls) == 1
    sinks.materialize_once(spark, path, build, key="other")
    assert len(calls) == 2


def test_materialize_once_sees_changed_inputs(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "t")

    def table():
        rows = spark.read.parquet(src)
        return sinks.materialize_once(spark, path, lambda: rows.selectExpr("id + 1 AS id"),
                                      inputs=[rows])
    spark.range(10).write.parquet(src)
    assert table().count() == table().count() == 10
    spark.range(5).write.mode("append").parquet(src)
    assert table().count() == 15
    spark.range(20, 24).write.mode("overwrite").parquet(src)
    assert sorted(r.id for r in table().collect()) == [21, 22, 23, 24]
    # A write that dies leaves the finished table, and nothing of its own, at the place.
    spark.range(3).write.mode("append").parquet(src)
    rows = spark.read.parquet(src)
    with pytest.raises(ZeroDivisionError):
        sinks.materialize_once(spark, path, lambda: 1 / 0, inputs=[rows])
    assert spark.read.parquet(path).count() == 4
    assert table().count() == 7


def test_pairing_files_rejects_and_unknown_tags(spark, tmp_path):
    from prescient.sources.snapshots import PAIRING_SCHEMA, read_pairings
    n = len(PAIRING_SCHEMA) - 2
    good = "7," + ",".join(str(i) for i in range(n)) + ",A"
    bad = ["8," + ",".join("1" for _ in range(n - 1)) + ",A",      # a field less
           "9," + ",".join("1" for _ in range(n)) + ",A,B",         # a field more
           "10," + ",".join("x" if i == 20 else "1" for i in range(n)) + ",A",
           "x," + ",".join("1" for _ in range(n)) + ",B"]
    head = ",".join(f"other{i}" for i in range(n + 2))  # names do not matter, places do
    for tag, lines in (("PvP", [good, *bad[:2]]), ("PvT", [good, good, *bad[2:]])):
        (tmp_path / f"data_{tag}.csv").write_text("\n".join([head, *lines]) + "\n")
    rows, rejects = read_pairings(spark, str(tmp_path / "data_*.csv"), ["PvP", "PvT"],
                                  r"data_([A-Za-z]+)\.csv$")
    assert sorted(r.Races for r in rows.select("Races").collect()) == ["PvP", "PvT", "PvT"]
    assert rows.agg(F.sum("ReplayID")).first()[0] == 21 and rows.count() == 3
    assert {(r.Races, r.line) for r in rejects.collect()} == \
        {("PvP", b) for b in bad[:2]} | {("PvT", b) for b in bad[2:]}
    rows, _ = read_pairings(spark, str(tmp_path / "data_*.csv"), ["PvP"], r"data_([A-Za-z]+)\.csv$")
    with pytest.raises(Exception, match="unknown pairing"):
        rows.select("ReplayID", "Races").collect()


def test_nearest_centre_by_blocks():
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(50, 4)), rng.normal(size=(37, 4))
    c[20] = c[3]
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2))
    for across in (1, 7, 100):
        cell, dist = knn._nearest_centre(x, c, across)
        assert (cell == d.argmin(axis=1)).all() and np.allclose(dist, d.min(axis=1))
        assert np.allclose(knn._dist_rows(x, c, 8, across), d)


def test_split_bits_are_the_repeated_splits(spark):
    snaps = inputs.snapshots(spark, SMALL).select("row_key", "frame")
    want = split.repeated_splits(snaps, 5)
    bits = split.split_bits(snaps, 5, odd_col="odd")
    for part in ("train", "test"):
        a = want.where(F.col("part") == part).groupBy("test_set").agg(
            F.count("*"), F.sum(F.xxhash64("row_key").cast("decimal(38,0)")))
        b = split.of_split(bits, 5, part == "train").groupBy("test_set").agg(
            F.count("*"), F.sum(F.xxhash64("row_key").cast("decimal(38,0)")))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    odd = split.of_split(bits, 5, None).withColumn("o", split.bit("odd", F.col("test_set")))
    both = odd.join(want, ["row_key", "frame", "test_set", "part"])
    assert both.where("o <> (bucket % 2 = 1)").count() == 0 and both.count() >= want.count()


def test_class_sums_by_bits_equal_explode(spark):
    snaps = inputs.snapshots(spark, SMALL)
    cols = ["quantity", "price"]
    train = split.repeated_splits(snaps, 3).where("part = 'train'")
    want = {(r.test_set, r.winner): (r.n_c, [round(x, 4) for x in r["sums"]])
            for r in nb.class_sums(train, cols, group_cols=["test_set"]).collect()}
    got = {(r.test_set, r.winner): (r.n_c, [round(x, 4) for x in r["sums"]])
           for r in nb.class_sums_by_bits(split.split_bits(snaps, 3), cols, 3).collect()}
    assert got == want


def test_number_from_path(spark, tmp_path):
    for c in (9000, 4500):
        spark.range(3).write.mode("overwrite").parquet(str(tmp_path / f"measures_{c}"))
    df = spark.read.parquet(str(tmp_path / "measures_*")).withColumn("cutoff", sinks.number_from_path())
    got = sorted(r["cutoff"] for r in df.select("cutoff").distinct().collect())
    assert got == [4500, 9000]


def test_study_schema_csv_roundtrip(spark, tmp_path):
    """A1/A2: the study's 31-column snapshot CSV, header on, declared schema."""
    from pyspark.sql import types as T

    from prescient.sources.snapshots import SNAPSHOT_SCHEMA, read_snapshot_csv
    cols = []
    for i, f in enumerate(SNAPSHOT_SCHEMA.fields):
        if isinstance(f.dataType, T.StringType):
            c = F.concat(F.lit(f.name[:1]), (F.col("id") % 7).cast("string"))
        elif isinstance(f.dataType, T.IntegerType):
            c = ((F.col("id") * (i + 3)) % 1000).cast("int")
        else:
            c = (F.col("id") / (i + 1)).cast("double")
        cols.append(c.alias(f.name))
    df = spark.range(50).select(*cols)
    path = str(tmp_path / "snap_csv")
    df.write.option("header", "true").csv(path)
    back = read_snapshot_csv(spark, path)
    assert back.schema == SNAPSHOT_SCHEMA
    assert sorted(back.collect()) == sorted(df.collect())


def test_stratified_folds_skewed_label(spark):
    """One label holds 90% of rows: folds still balanced within 1 per label."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_key"),
                                  F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("winner"))
    f = split.stratified_folds(df, "winner", 7, "s")
    sizes = {}
    for r in f.groupBy("winner", "fold").count().collect():
        sizes.setdefault(r["winner"], []).append(r["count"])
    assert sorted(sizes) == ["a", "b"]
    for v in sizes.values():
        assert len(v) == 7 and max(v) - min(v) <= 1
    assert f.select("row_key").distinct().count() == 5000


def test_knn_query_in_cell_without_train_rows(spark):
    """Queries far from every train row, with more cells than train clusters:
    still exact (a query with no own-cell candidates searches everywhere)."""
    train = [(i, [float(i % 5), float(i % 3)], i % 2) for i in range(60)]
    test = [(1000 + i, [50.0 + i, -40.0], 0) for i in range(10)] + \
           [(2000 + i, [float(i % 4), 1.0], 0) for i in range(10)]
    schema = "vec_id long, embedding array<double>, label int"
    tdf, qdf = spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
    nn = knn.nearest(qdf, tdf, 3, n_cells=12, block_rows=8)
    got = {}
    for r in nn.orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["t_id"])
    assert got == _brute(train, test, 3)


def test_knn_blocks_never_exceed_their_bound(spark):
    """A cell with most rows, repeated ids included, is dealt into blocks of at most 64."""
    rows = [(i if i % 3 else 7, 0 if i % 10 else 1, [float(i % 11)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, cell int, v array<double>")
    dealt = knn.deal(df, "id", "v", 64, "block").cache()
    assert dealt.groupBy("cell", "block").count().agg({"count": "max"}).first()[0] <= 64
    assert dealt.count() == 1500


def test_knn_string_ids_on_unclustered_vectors(spark, monkeypatch):
    """Any id and label type; no search call gets more than ``block_rows`` rows a side."""
    import random
    rnd = random.Random(5)
    train = [(i, [rnd.random() for _ in range(6)], 0) for i in range(700)]
    test = [(1000 + i, [rnd.random() for _ in range(6)], 0) for i in range(400)]
    schema = "vec_id string, embedding array<double>, label string"
    tdf, qdf = (spark.createDataFrame([(f"{i:05d}", v, "x") for i, v, _ in rows], schema)
                for rows in (train, test))
    plain = knn._block_topk

    def bounded(*args):
        fn = plain(*args)

        def check(key, q, t):
            assert len(q) <= 64 and len(t) <= 64, (key, len(q), len(t))
            return fn(key, q, t)
        return check
    monkeypatch.setattr(knn, "_block_topk", bounded)
    nn = knn.nearest(qdf, tdf, 4, n_cells=8, block_rows=64)
    got = {}
    for r in nn.orderBy("q_id", "rank").collect():
        got.setdefault(int(r["q_id"]), []).append(int(r["t_id"]))
    assert got == _brute(train, test, 4)


def test_stratified_split_takes_the_exact_share(spark):
    """0.55 of 100 rows is 55 (the product of doubles rounds up to 56)."""
    df = spark.range(100).select(F.col("id").cast("string").alias("row_key"),
                                 F.lit("a").alias("winner"))
    out = split.stratified_split(df, "winner", 0.55)
    assert out.where("part = 'train'").count() == 55


def test_nb_one_scoring_path_for_many_models(spark):
    """200 models of 28 features and 3 labels against numpy; a null feature gives label index 0."""
    rng = np.random.default_rng(5)
    cols = [f"x{i}" for i in range(28)]
    rows = [(i % 200, "abc"[int(rng.integers(3))], *map(float, rng.integers(0, 9, 28)))
            for i in range(4000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "winner", *cols]))
    holes = df.withColumn("x3", F.when(F.col("g") % 7 == 0, F.lit(None)).otherwise(F.col("x3")))
    params = nb.fit_params(df, cols, group_cols=["g"])
    got = nb.predict(holes, params, cols, group_cols=["g"], majority_col="maj").collect()
    model = {}
    for r in params.collect():
        model.setdefault(r["g"], []).append(r)
    assert len(got) == 4000
    for r in got:
        classes = sorted(model[r["g"]], key=lambda c: c["label_idx"])
        best = 0
        if r["x3"] is not None:
            best = int(np.argmax([c["pi"] + np.dot(c["theta"], [r[c2] for c2 in cols])
                                  for c in classes]))
        assert r["prediction"] == classes[best]["winner"]
        assert r["maj"] == classes[0]["winner"]


def test_nb_input_rules(spark):
    """Rows without a label or a group's model, null and negative features."""
    train = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 1.0), ("b", 5.0, 0.0),
                                   (None, 9.0, 9.0)], "winner string, x double, y double")
    got = {r["winner"]: (r["n_c"], r["sums"]) for r in nb.class_sums(train, ["x", "y"]).collect()}
    assert got == {"a": (2, [1.0, 3.0]), "b": (1, [5.0, 0.0])}
    with pytest.raises(Exception, match="negative value of x"):
        nb.class_sums(train.withColumn("x", -F.col("x")), ["x", "y"]).collect()


def test_knn_on_snapshots_equals_brute_force(spark):
    from prescient.plans.q_knn import snapshot_predictions
    snaps = inputs.snapshots(spark, SMALL).orderBy("row_key").limit(500).cache()
    got = {(r["test_set"], r["row_key"]): r["prediction"]
           for r in snapshot_predictions(split.split_bits(snaps, 2), n_splits=2).collect()}
    want = {}
    for s in (1, 2):
        rows = split.hash_split(snaps, s).collect()
        train = [r for r in rows if r["part"] == "train"]
        x = np.array([[float(r[c]) for c in NUMERIC_FEATURES] for r in train])
        for q in (r for r in rows if r["part"] == "test"):
            d = np.sqrt(((x - [float(q[c]) for c in NUMERIC_FEATURES]) ** 2).sum(axis=1))
            near = sorted(range(len(train)), key=lambda i: (d[i], train[i]["row_key"]))[:3]
            labels = [train[i]["winner"] for i in near]
            want[s, q["row_key"]] = max(labels, key=lambda v: (labels.count(v), -labels.index(v)))
    assert got == want and len(got) > 200
