"""Queries: scans and sinks, filters, reshaping, keys, joins of preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prescient.functions.frames import ADAPTER_STEP, frames_to_minutes
from prescient.operators import prep
from prescient.plans import inputs
from prescient.plans.oracle import DURATION, SNAPSHOTS, with_
from prescient.plans.registry import query, r6
from prescient.session import scratch_path
from prescient.sources import sinks
from prescient.sources.snapshots import (ADAPTER_ENEMY, ADAPTER_PAIRS, ENEMY_PREFIX,
                                         FEATURE_GROUPS, NUMERIC_FEATURES, PAIRING_SCHEMA,
                                         read_pairings)


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("csv_roundtrip", with_(SNAPSHOTS) + "SELECT * FROM snapshots")
def csv_roundtrip(spark, sf_dir):
    """Write the snapshot table as header CSV (many parts), read it back with
    the declared schema and no inference."""
    snaps = inputs.snapshots(spark, sf_dir)
    path = _fresh(spark, "csv_roundtrip")
    sinks.write_csv(snaps, path)
    return (spark.read.option("header", "true").option("inferSchema", "false")
            .schema(snaps.schema).csv(path))


@query("multi_part_scan", with_(SNAPSHOTS) + """
SELECT races, count(*) AS n, round(sum(price), 2) AS price_sum FROM snapshots GROUP BY races""")
def multi_part_scan(spark, sf_dir):
    """One folder, one sub-folder per pairing, several part files each; the
    folder scan row-binds them all (pairing recovered by partition discovery)."""
    snaps = inputs.snapshots(spark, sf_dir)
    path = _fresh(spark, "multi_part")
    sinks.write_csv(snaps, path, partition_by=["races"])
    back = (spark.read.option("header", "true")
            .schema(snaps.drop("races").schema).csv(path))
    return back.groupBy("races").agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.sum("price"), 2).alias("price_sum"))


@query("cutoff_filter", with_(SNAPSHOTS) + """
SELECT row_key, replay_id, frame, winner FROM snapshots WHERE frame < 1000""")
def cutoff_filter(spark, sf_dir):
    """Rows with frame < 1000 (the bound also reaches the parquet scan)."""
    snaps = inputs.snapshots(spark, sf_dir, frame_below=1000)
    return prep.before_cutoff(snaps, 1000).select("row_key", "replay_id", "frame", "winner")


@query("cutoff_filter_none", with_(SNAPSHOTS) + """
SELECT row_key, replay_id, frame, winner FROM snapshots""")
def cutoff_filter_none(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir)
    return prep.before_cutoff(snaps, None).select("row_key", "replay_id", "frame", "winner")


@query("match_metadata", with_(SNAPSHOTS, DURATION) + """
SELECT DISTINCT replay_id, duration, races FROM snaps_d""")
def match_metadata(spark, sf_dir):
    return prep.match_metadata(inputs.snapshots(spark, sf_dir))


@query("drop_columns", with_(SNAPSHOTS, DURATION) + """
SELECT row_key, frame, quantity, price, discount, tax, linenumber, enemy_quantity,
       enemy_price, winner FROM snaps_d""")
def drop_columns(spark, sf_dir):
    """The predictor table: everything but match id, duration and pairing.
    (Duration is dropped, so it is never computed: same rows, no join.)"""
    snaps = inputs.snapshots(spark, sf_dir)
    return snaps.drop("replay_id", "duration", "races")


@query("composite_key", with_(SNAPSHOTS) + """
SELECT row_key, concat_ws('_', races, replay_id) AS match_key FROM snapshots""")
def composite_key(spark, sf_dir):
    snaps = inputs.snapshots(spark, sf_dir)
    return prep.composite_key(snaps, ["races", "replay_id"]).select("row_key", "match_key")


@query("regex_filter", with_(SNAPSHOTS) + """
SELECT row_key, match_key, frame FROM (
  SELECT row_key, frame, concat_ws('_', races, replay_id) AS match_key FROM snapshots)
WHERE regexp_matches(match_key, '^R_[0-9]*7$')""")
def regex_filter(spark, sf_dir):
    """Rows whose composite key matches a pattern (pairing R, id ending in 7)."""
    snaps = prep.composite_key(inputs.snapshots(spark, sf_dir), ["races", "replay_id"])
    return snaps.where(F.col("match_key").rlike("^R_[0-9]*7$")).select("row_key", "match_key", "frame")


#: Columns of the snapshots that stand for the 28 numbers of a per-pairing file.
_NUMBERS = [NUMERIC_FEATURES[i % len(NUMERIC_FEATURES)] for i in range(len(PAIRING_SCHEMA) - 2)]


@query("union_pairings", with_(SNAPSHOTS) + f"""
, tagged AS (SELECT *, races || CAST(CAST(linenumber AS INTEGER) % 2 AS VARCHAR) AS pairing
             FROM snapshots)
SELECT pairing || '_' || replay_id AS match_key, pairing, winner,
       {", ".join(f'CAST({c} AS DOUBLE) AS {f.name}' for c, f in
                  zip(_NUMBERS[:10], PAIRING_SCHEMA.fields[1:11], strict=True))},
       round({" + ".join(_NUMBERS)}, 4) AS total
FROM tagged""")
def union_pairings(spark, sf_dir):
    """Six per-pairing files (return flag, odd or even line) written with the study's 30
    columns, read back in one scan with the tag from the path; none is lost."""
    snaps = inputs.snapshots(spark, sf_dir).withColumn("pairing", F.concat(
        "races", (F.col("linenumber").cast("int") % 2).cast("string")))
    path = _fresh(spark, "pairings")
    names = [f.name for f in PAIRING_SCHEMA.fields]
    snaps.select("pairing", F.col("replay_id").cast("int").alias(names[0]),
                 *[F.col(c).cast("double").alias(n) for c, n in zip(_NUMBERS, names[1:-1], strict=True)],
                 F.col("winner").alias(names[-1])) \
        .write.partitionBy("pairing").option("header", "true").csv(path)
    rows, _ = read_pairings(spark, f"{path}/pairing=*", [a + b for a in "ANR" for b in "01"],
                            r"/pairing=([^/]*)/")
    total = F.lit(0.0)
    for n in names[1:-1]:
        total = total + F.col(n)
    keyed = prep.composite_key(rows, ["Races", "ReplayID"])
    return keyed.select("match_key", F.col("Races").alias("pairing"), F.col("Winner").alias("winner"),
                        *names[1:11], F.round(total, 4).alias("total"))


_PAIRED_SQL = with_(SNAPSHOTS) + """
SELECT frame, replay_id, 'quantity' AS variable, quantity AS value, enemy_quantity AS value2
FROM snapshots
UNION ALL
SELECT frame, replay_id, 'price', price, enemy_price FROM snapshots"""


@query("paired_long", _PAIRED_SQL)
def paired_long(spark, sf_dir):
    return prep.paired_long(inputs.snapshots(spark, sf_dir), ADAPTER_PAIRS)


#: Column of the snapshots behind each column of a per-pairing file.
_BEHIND = {f.name: c for f, c in zip(PAIRING_SCHEMA.fields[1:-1], _NUMBERS, strict=True)}


@query("paired_groups", with_(SNAPSHOTS) + " UNION ALL ".join(
    f"""
SELECT CAST({_BEHIND["Frame"]} AS DOUBLE) AS Frame, replay_id AS ReplayID, {i} AS feature_group,
       '{own}' AS variable, CAST({_BEHIND[own]} AS DOUBLE) AS value,
       CAST({_BEHIND[ENEMY_PREFIX + own]} AS DOUBLE) AS value2
FROM snapshots""" for i, group in enumerate(FEATURE_GROUPS, 1) for own in group))
def paired_groups(spark, sf_dir):
    """All 13 own columns of the per-pairing layout beside the other side's, in the
    study's five groups, in one pass."""
    wide = inputs.snapshots(spark, sf_dir).select(
        F.col("replay_id").alias("ReplayID"),
        *[F.col(c).cast("double").alias(n) for n, c in _BEHIND.items()])
    return prep.paired_groups(wide, FEATURE_GROUPS, prefix=ENEMY_PREFIX)


@query("self_equi_join", _PAIRED_SQL)
def self_equi_join(spark, sf_dir):
    """The pairing as an equi-join of the melted own and enemy views."""
    own = [o for o, _ in ADAPTER_PAIRS]
    return prep.paired_by_join(inputs.snapshots(spark, sf_dir), own, ADAPTER_ENEMY)


@query("semi_join_sample", with_(SNAPSHOTS) + """
SELECT row_key, replay_id, frame, winner FROM snapshots WHERE replay_id IN (
  SELECT replay_id FROM (SELECT DISTINCT replay_id FROM snapshots)
  ORDER BY md5(concat_ws('_', '42', replay_id)), replay_id LIMIT 3)""")
def semi_join_sample(spark, sf_dir):
    """All snapshots of 3 matches drawn with seed 42."""
    snaps = inputs.snapshots(spark, sf_dir)
    ids = prep.sample_matches(snaps, 3, 42)
    return prep.rows_of_matches(snaps, ids).select("row_key", "replay_id", "frame", "winner")


@query("duration_stats", with_(SNAPSHOTS, DURATION) + """
SELECT max(duration) AS max_duration,
       round(avg(duration), 6) AS mean_duration_snapshots,
       round(avg(duration) / CAST(900 AS DOUBLE), 6) AS mean_minutes_snapshots,
       (SELECT round(avg(d), 6) FROM (SELECT max(frame) AS d FROM snapshots GROUP BY replay_id))
         AS mean_duration_matches
FROM snaps_d""")
def duration_stats(spark, sf_dir):
    """Max and mean duration over snapshots (as the study: long matches
    weigh more) and the per-match mean, from one per-match aggregate."""
    d = prep.duration_summary(inputs.snapshots(spark, sf_dir))
    return d.select("max_duration",
                    r6("mean_duration_snapshots").alias("mean_duration_snapshots"),
                    r6(frames_to_minutes(F.col("mean_duration_snapshots")))
                    .alias("mean_minutes_snapshots"),
                    r6("mean_duration_matches").alias("mean_duration_matches"))


@query("class_counts", with_(SNAPSHOTS) + """
SELECT 'winner' AS column_name, winner AS value, count(*) AS n FROM snapshots GROUP BY winner
UNION ALL
SELECT 'races', races, count(*) FROM snapshots GROUP BY races""")
def class_counts(spark, sf_dir):
    """Frequency of each label and each pairing (what the indexers count)."""
    snaps = inputs.snapshots(spark, sf_dir)
    long = snaps.select(F.inline(F.array(
        F.struct(F.lit("winner").alias("column_name"), F.col("winner").alias("value")),
        F.struct(F.lit("races").alias("column_name"), F.col("races").alias("value")))))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("cutoff_list", with_(SNAPSHOTS) + f"""
SELECT CAST(row_number() OVER (ORDER BY cutoff) AS INTEGER) AS cutoff_idx, cutoff FROM (
  SELECT CAST(unnest(range({ADAPTER_STEP}, {ADAPTER_STEP * 19 + 1}, {ADAPTER_STEP})) AS INTEGER)
         AS cutoff
  UNION ALL SELECT max(frame) FROM snapshots)""")
def cutoff_list(spark, sf_dir):
    """19 regular cutoffs, then the longest match (max duration) appended."""
    snaps = inputs.snapshots(spark, sf_dir)
    regular = F.sequence(F.lit(ADAPTER_STEP), F.lit(ADAPTER_STEP * 19), F.lit(ADAPTER_STEP))
    arr = F.concat(regular, F.array(F.max("frame")))
    return (snaps.agg(arr.alias("c"))
            .select(F.posexplode("c"))
            .select((F.col("pos") + 1).cast("int").alias("cutoff_idx"),
                    F.col("col").cast("int").alias("cutoff")))
