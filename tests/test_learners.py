"""Learners on planted-signal tables (the driver tables carry no signal)."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from prescient.operators import features as fe
from prescient.operators import learners as L
from prescient.operators import split, sweep
from prescient.sources.snapshots import NUMERIC_FEATURES


@pytest.fixture(scope="module")
def planted_matches(spark):
    """200 matches x 40 frames with the full adapter schema: each match has
    a winner; the quantity gap between the sides points to it with a signal
    that grows with the frame, so late snapshots are easy and early ones are
    mostly noise."""
    n = 200 * 40
    df = spark.range(n).select(
        (F.col("id") % 200).cast("string").alias("replay_id"),
        ((F.col("id") / 200).cast("int") * 50 + 1).alias("frame"),
        F.col("id"))
    sign = F.when(F.col("replay_id").cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    noise = ((F.col("id") * 7919) % 101).cast("double") / 100.0 - 0.5
    gap = sign * F.col("frame") / 2000.0 + noise
    return (df.select(
        F.concat_ws("_", "replay_id", "frame").alias("row_key"), "replay_id", "frame",
        (25.0 + 20.0 * gap).alias("quantity"),
        ((F.col("id") * 31) % 1000 + 100.0).alias("price"),
        F.lit(0.05).alias("discount"), F.lit(0.02).alias("tax"),
        ((F.col("id") % 7) + 1.0).alias("linenumber"),
        (25.0 - 20.0 * gap).alias("enemy_quantity"),
        ((F.col("id") * 17) % 1000 + 100.0).alias("enemy_price"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("races"),
        F.when(sign > 0, "O").otherwise("F").alias("winner"))
        .where((F.col("quantity") >= 0) & (F.col("enemy_quantity") >= 0)).cache())


def _accuracy(model, test, name="m"):
    p = L.predictions(model, test, name, ["row_key", "frame", "winner"])
    return sweep.accuracy(p, ["classifier"]).collect()[0]["accuracy"]


@pytest.fixture(scope="module")
def parts(planted_matches):
    s = split.hash_split(planted_matches, 1)
    return s.where("part = 'train'").cache(), s.where("part = 'test'").cache()


@pytest.mark.parametrize("name,est,floor", [
    ("LR", lambda: L.lr(0.0), 0.70),
    ("RF", lambda: L.rf(5), 0.70),
    ("GBT", lambda: L.gbt(3), 0.70),
])
def test_learners_find_signal(parts, name, est, floor):
    train, test = parts
    model = L.pipeline(est()).fit(train)
    assert _accuracy(model, test, name) >= floor


def test_curve_rises_with_cutoff(parts):
    train, test = parts
    model = L.pipeline(L.lr(0.0)).fit(train)
    p = L.predictions(model, test, "LR", ["row_key", "frame", "winner"])
    curve = {r["cutoff"]: r["accuracy"] for r in
             sweep.accuracy_curve(p, [200, 1000, 2001], ["classifier"]).collect()}
    late = sweep.accuracy(p.where(F.col("frame") >= 1000), ["classifier"]).collect()[0]["accuracy"]
    early = sweep.accuracy(p.where(F.col("frame") < 200), ["classifier"]).collect()[0]["accuracy"]
    assert late > early
    assert curve[2001] >= curve[200]


def test_importance_sums_to_one_and_finds_gap(parts):
    train, _ = parts
    model = L.pipeline(L.rf(5)).fit(train)
    imp = {r["feature"]: r["importance"] for r in L.importances(model, fe.MODEL_INPUTS).collect()}
    assert sum(imp.values()) == pytest.approx(1.0)
    top2 = sorted(imp, key=imp.get, reverse=True)[:2]
    assert set(top2) == {"quantity", "enemy_quantity"}


def test_grid_search_with_fold_column(parts):
    train, _ = parts
    train = split.stratified_folds(train, "winner", 3, "cv")
    est, grid = L.families(len(fe.MODEL_INPUTS))["NB"]
    model, table = L.grid_search(train, est, grid, fold_col="fold", folds=3)
    rows = table.collect()
    assert len(rows) == 2 and all(0.0 <= r["accuracy"] <= 1.0 for r in rows)


def test_model_save_load_same_predictions(parts, tmp_path):
    train, test = parts
    model = L.pipeline(L.lr(0.3)).fit(train)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    a = L.predictions(model, test, "x", ["row_key"]).orderBy("row_key").collect()
    b = L.predictions(back, test, "x", ["row_key"]).orderBy("row_key").collect()
    assert a == b


def test_svm_variants_run(parts):
    train, test = parts
    n = train.count()
    m = L.pipeline(L.svm_linear(1.0, n), extra=[L.scaler(inp=fe.INDEXED_FEATURES)]).fit(train)
    assert _accuracy(m, test) >= 0.70
    assert len(NUMERIC_FEATURES) == 8


def test_fit_or_load_reuses_saved_model(parts, tmp_path):
    train, test = parts
    path = str(tmp_path / "lr")
    first = L.fit_or_load(L.pipeline(L.lr(0.3)), train, path)
    # a second call must load, not fit: an estimator that cannot fit proves it
    again = L.fit_or_load(L.pipeline(L.lr(0.3)), train.limit(0), path)
    a = L.predictions(first, test, "x", ["row_key"]).orderBy("row_key").collect()
    b = L.predictions(again, test, "x", ["row_key"]).orderBy("row_key").collect()
    assert a == b
