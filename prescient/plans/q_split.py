"""Queries: splits, folds and feature stages."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from prescient.operators import features as fe
from prescient.operators import split
from prescient.plans import inputs
from prescient.plans.oracle import SNAPSHOTS, h, with_
from prescient.plans.registry import query
from prescient.sources.snapshots import NUMERIC_FEATURES


@query("hash_split_70_30", with_(SNAPSHOTS) + f"""
SELECT row_key, CASE WHEN {h("1")} % 1000 < 700 THEN 'train' ELSE 'test' END AS part
FROM snapshots""")
def hash_split_70_30(spark, sf_dir):
    return split.hash_split(inputs.snapshots(spark, sf_dir), 1).select("row_key", "part")


@query("repeated_splits", with_(SNAPSHOTS) + f"""
SELECT CAST(t.test_set AS INTEGER) AS test_set,
       CASE WHEN {h("t.test_set", "s.row_key")} % 1000 < 700 THEN 'train' ELSE 'test' END AS part,
       count(*) AS n, CAST(sum(frame) AS BIGINT) AS frame_sum
FROM snapshots s CROSS JOIN (SELECT range AS test_set FROM range(1, 6)) t
GROUP BY ALL""")
def repeated_splits(spark, sf_dir):
    rows = inputs.split_rows(spark, sf_dir)
    return rows.groupBy("test_set", "part").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum("frame").alias("frame_sum"))


@query("stratified_split", with_(SNAPSHOTS) + """
SELECT row_key, winner,
       CASE WHEN row_number() OVER (PARTITION BY winner
                                    ORDER BY md5(concat_ws('_', 'strat', row_key)), row_key)
                 <= ceil(count(*) OVER (PARTITION BY winner) * 0.8)
            THEN 'train' ELSE 'test' END AS part
FROM snapshots""")
def stratified_split(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir).select("row_key", "winner")
    return split.stratified_split(snaps, "winner", 0.8, "strat")


@query("fold_assignment", with_(SNAPSHOTS) + f"""
SELECT row_key, CAST({h("'fold7'")} % 10 AS INTEGER) AS fold FROM snapshots""")
def fold_assignment(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir).select("row_key")
    return split.fold_assignment(snaps, 10, 7)


@query("stratified_folds", with_(SNAPSHOTS) + """
SELECT row_key, winner,
       CAST((row_number() OVER (PARTITION BY winner
                                ORDER BY md5(concat_ws('_', 'folds', row_key)), row_key) - 1) % 10
            AS INTEGER) AS fold
FROM snapshots""")
def stratified_folds(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir).select("row_key", "winner")
    return split.stratified_folds(snaps, "winner", 10, "folds")


_INDEX_CTE = """
idx_w AS (SELECT winner, CAST(row_number() OVER (ORDER BY count(*) DESC, winner) - 1 AS DOUBLE)
                 AS winner_idx FROM snapshots GROUP BY winner),
idx_r AS (SELECT races, CAST(row_number() OVER (ORDER BY count(*) DESC, races) - 1 AS DOUBLE)
                 AS races_idx FROM snapshots GROUP BY races)"""


@query("string_index", with_(SNAPSHOTS, _INDEX_CTE) + """
SELECT row_key, winner_idx, races_idx FROM snapshots JOIN idx_w USING (winner)
JOIN idx_r USING (races)""")
def string_index(spark, sf_dir):
    """Label and pairing to indices by descending frequency (ties alphabetical)."""
    snaps = inputs.snapshots(spark, sf_dir)
    m = StringIndexer(inputCols=["winner", "races"], outputCols=["winner_idx", "races_idx"],
                      stringOrderType="frequencyDesc").fit(snaps)
    return m.transform(snaps).select("row_key", "winner_idx", "races_idx")


_SLOT_LIST = ", ".join(f"CAST({c} AS DOUBLE)" for c in NUMERIC_FEATURES) + ", races_idx"
_N_SLOTS = len(NUMERIC_FEATURES) + 1

_SLOTS_CTE = f"""
slots AS (
  SELECT row_key, CAST(unnest(range(0, {_N_SLOTS})) AS INTEGER) AS slot,
         unnest([{_SLOT_LIST}]) AS value
  FROM snapshots JOIN idx_r USING (races)
)"""


def _assembled(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir)
    ix = StringIndexer(inputCol="races", outputCol=fe.CATEGORY_IDX,
                       stringOrderType="frequencyDesc").fit(snaps)
    return fe.assembler().transform(ix.transform(snaps))


@query("assemble_features", with_(SNAPSHOTS, _INDEX_CTE, _SLOTS_CTE) + """
SELECT row_key, slot, value FROM slots""")
def assemble_features(spark, sf_dir):
    """8 numeric columns + indexed pairing -> one vector; shown as slots."""
    return fe.vector_slots(_assembled(spark, sf_dir), fe.FEATURES, ["row_key"])


@query("vector_index", with_(SNAPSHOTS, _INDEX_CTE, _SLOTS_CTE) + f"""
, cat AS (SELECT slot FROM slots GROUP BY slot HAVING count(DISTINCT value) <= {fe.MAX_CATEGORIES}),
zero AS (SELECT slot, max(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS has_zero FROM slots
         WHERE slot IN (SELECT slot FROM cat) GROUP BY slot),
vals AS (SELECT DISTINCT slot, value FROM slots WHERE slot IN (SELECT slot FROM cat)),
codes AS (
  SELECT v.slot, v.value,
         CAST(CASE WHEN v.value = 0 THEN 0
              ELSE z.has_zero + row_number() OVER (PARTITION BY v.slot, v.value = 0
                                                   ORDER BY v.value) - 1 END AS DOUBLE) AS code
  FROM vals v JOIN zero z USING (slot))
SELECT s.row_key, s.slot, c.code AS value FROM slots s JOIN codes c USING (slot, value)""")
def vector_index(spark, sf_dir):
    """Slots with <= 6 distinct values become categorical codes (0.0 -> 0,
    the rest ascending); output: the coded slots of every row."""
    asm = _assembled(spark, sf_dir)
    model = fe.vector_indexer().fit(asm)
    cats = sorted(model.categoryMaps.keys())
    out = fe.vector_slots(model.transform(asm), fe.INDEXED_FEATURES, ["row_key"])
    return out.where(F.col("slot").isin(cats))


@query("index_to_label", with_(SNAPSHOTS, _INDEX_CTE) + """
SELECT row_key, winner_idx, winner AS winner_label FROM snapshots JOIN idx_w USING (winner)""")
def index_to_label(spark, sf_dir):
    """Index the label, then map indices back to label strings."""
    snaps = inputs.snapshots(spark, sf_dir)
    m = StringIndexer(inputCol="winner", outputCol="winner_idx",
                      stringOrderType="frequencyDesc").fit(snaps)
    conv = fe.label_converter(m.labels, "winner_idx", "winner_label")
    return conv.transform(m.transform(snaps)).select("row_key", "winner_idx", "winner_label")


_FORMULA_SLOTS = ", ".join(f"CAST({c} AS DOUBLE)" for c in NUMERIC_FEATURES)


@query("rformula", with_(SNAPSHOTS, _INDEX_CTE) + f"""
SELECT row_key, winner_idx AS label,
       CAST(unnest(range(0, {len(NUMERIC_FEATURES)})) AS INTEGER) AS slot,
       unnest([{_FORMULA_SLOTS}]) AS value
FROM snapshots JOIN idx_w USING (winner)""")
def rformula(spark, sf_dir):
    """'winner ~ . - row_key - replay_id - races': label index + the 8 numeric
    columns in table order (the R script's predictors)."""
    snaps = inputs.snapshots(spark, sf_dir)
    f = fe.rformula("winner ~ . - row_key - replay_id - races").fit(snaps)
    return fe.vector_slots(f.transform(snaps), "features", ["row_key", "label"])


@query("match_level_split", with_(SNAPSHOTS) + f"""
SELECT row_key, replay_id,
       CASE WHEN {h("1", "replay_id")} % 1000 < 700 THEN 'train' ELSE 'test' END AS part
FROM snapshots""")
def match_level_split(spark, sf_dir):
    """70/30 split at match level: every snapshot of a match on one side
    (the study split rows, which lets a match's own snapshots leak across)."""
    snaps = inputs.snapshots(spark, sf_dir).select("row_key", "replay_id")
    return split.by_match(snaps, 1)


@query("materialized_splits", with_(SNAPSHOTS) + f"""
SELECT CAST(t.test_set AS INTEGER) AS test_set,
       CASE WHEN {h("t.test_set", "s.row_key")} % 1000 < 700 THEN 'train' ELSE 'test' END AS part,
       count(*) AS n
FROM snapshots s CROSS JOIN (SELECT range AS test_set FROM range(1, 6)) t
GROUP BY ALL""")
def materialized_splits(spark, sf_dir):
    """The snapshots written once with a bit for each of five splits, and re-read by
    every later call (reuse-or-create on a manifest of the key and the input files)."""
    rows = split.of_split(inputs.split_table(spark, sf_dir), inputs.N_SPLITS, None)
    return rows.groupBy("test_set", "part").agg(F.count(F.lit(1)).alias("n"))
