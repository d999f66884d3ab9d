"""Preparation of snapshot tables: union of pairings, keys, match metadata,
own/enemy reshaping, samples of matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_pairings(parts: dict[str, DataFrame], tag_col: str = "races") -> DataFrame:
    """Tag every per-pairing table with its pairing name and stack them."""
    tagged = [df.withColumn(tag_col, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def composite_key(df: DataFrame, cols: list[str], out_col: str = "match_key",
                  sep: str = "_") -> DataFrame:
    return df.withColumn(out_col, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))


def match_metadata(snaps: DataFrame, match: str = "replay_id", frame: str = "frame",
                   category: str = "races") -> DataFrame:
    """One row per distinct (match, duration, pairing); duration = max frame.

    A partial aggregate per (match, pairing) leaves a handful of rows per
    match, and a window over the match's rows adds its duration: one scan,
    no join back to the snapshots, and a hot match shrinks to its number of
    pairings before the second shuffle.
    """
    per = snaps.groupBy(match, category).agg(F.max(frame).alias("_m"))
    return (per.withColumn("duration", F.max("_m").over(Window.partitionBy(match)))
            .select(match, "duration", category))


def duration_summary(snaps: DataFrame, match: str = "replay_id", frame: str = "frame") -> DataFrame:
    """One row: max duration, mean duration over snapshots (long matches weigh
    more, as in the study) and mean over matches.

    From one per-match aggregate (d = max frame, n = rows): the snapshot
    mean of the duration is sum(n * d) / sum(n).
    """
    per = snaps.groupBy(match).agg(F.max(frame).alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("d").alias("max_duration"),
                   (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_duration_snapshots"),
                   F.avg("d").alias("mean_duration_matches"))


def before_cutoff(snaps: DataFrame, cutoff: float | None, frame: str = "frame") -> DataFrame:
    """Rows with frame < cutoff; ``None`` keeps every row."""
    if cutoff is None:
        return snaps
    return snaps.where(F.col(frame) < F.lit(cutoff))


def paired_long(snaps: DataFrame, pairs: list[tuple[str, str]],
                id_cols=("frame", "replay_id"), prefix: str = "enemy_") -> DataFrame:
    """Wide -> long with each own column next to its enemy column.

    One generator pass (``inline`` of an array of structs), no join: each
    input row yields one output row per pair.
    """
    arr = F.array(*[F.struct(F.lit(own).alias("variable"),
                             F.col(own).cast("double").alias("value"),
                             F.col(enemy).cast("double").alias("value2"))
                    for own, enemy in pairs])
    return snaps.select(*id_cols, F.inline(arr))


def paired_groups(snaps: DataFrame, groups: list[list[str]], id_cols=("Frame", "ReplayID"),
                  prefix: str = "Enemy") -> DataFrame:
    """Wide -> long for a list of column groups: each own column next to the column of
    the same name with ``prefix``, and the number of its group from 1.

    One generator pass whatever the number of groups. A null value stays a row with a
    null; a column that is not there, on either side, is an error.
    """
    pairs = [(i, own) for i, group in enumerate(groups, 1) for own in group]
    arr = F.array(*[F.struct(F.lit(i).alias("feature_group"), F.lit(own).alias("variable"),
                             F.col(own).cast("double").alias("value"),
                             F.col(prefix + own).cast("double").alias("value2"))
                    for i, own in pairs])
    return snaps.select(*id_cols, F.inline(arr))


def paired_by_join(snaps: DataFrame, own_cols: list[str], enemy_cols: list[str],
                   row_id: str = "row_key", id_cols=("frame", "replay_id"),
                   prefix: str = "enemy_") -> DataFrame:
    """Same result as ``paired_long`` as a self equi-join of two melted views.

    The study merged the melted own and enemy tables on (frame, match) and
    then kept rows whose enemy variable equals 'Enemy' + own variable. Doing
    that literally emits all pairs inside a (frame, match) group; here the
    predicate is a join key (variable name with the prefix stripped) and the
    row id is a key too, so every own row meets exactly one enemy row.
    """
    ids = [row_id, *id_cols]
    own = snaps.unpivot(ids, own_cols, "variable", "value")
    en = (snaps.select(row_id, *enemy_cols)
          .unpivot([row_id], enemy_cols, "enemy_variable", "value2")
          .withColumn("variable", F.regexp_replace("enemy_variable", f"^{prefix}", "")))
    return (own.join(en, [row_id, "variable"])
            .select(*id_cols, "variable", F.col("value").cast("double").alias("value"),
                    F.col("value2").cast("double").alias("value2")))


def sample_matches(snaps: DataFrame, n: int, seed: int, id_col: str = "replay_id") -> DataFrame:
    """``n`` match ids chosen by md5(seed_id) order: a seeded, exact sample.

    ``orderBy().limit(n)`` runs as a per-partition top-n and a merge of
    n rows per partition, so the ids never pass whole through one task.
    """
    ids = snaps.select(id_col).distinct()
    order = F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(id_col).cast("string")))
    return ids.orderBy(order, F.col(id_col)).limit(n)


def rows_of_matches(snaps: DataFrame, ids: DataFrame, id_col: str = "replay_id") -> DataFrame:
    """Semi join: snapshots of the chosen matches (the id side has n rows)."""
    return snaps.join(F.broadcast(ids), id_col, "left_semi")
