"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement restates the query in plain SQL over the driver's views, with
the adapter view and the prediction table as CTEs. Doubles that come from
sums are rounded to 6 places on both sides.
"""

from __future__ import annotations

from prescient.functions.frames import ADAPTER_CUTOFFS


def h(salt: str, key: str = "row_key") -> str:
    """md5 bucket, same as functions.hashing.md5_bucket."""
    return (f"CAST(('0x' || substr(md5(concat_ws('_', CAST({salt} AS VARCHAR), "
            f"CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT)")


SNAPSHOTS = """
snapshots AS (
  SELECT concat_ws('_', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(frame AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_key,
         CAST(l_orderkey AS VARCHAR) AS replay_id,
         frame,
         CAST(l_quantity AS DOUBLE) AS quantity,
         CAST(l_extendedprice AS DOUBLE) AS price,
         CAST(l_discount AS DOUBLE) AS discount,
         CAST(l_tax AS DOUBLE) AS tax,
         CAST(l_linenumber AS DOUBLE) AS linenumber,
         CAST(51.0 AS DOUBLE) - l_quantity AS enemy_quantity,
         l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount) AS enemy_price,
         l_returnflag AS races,
         l_linestatus AS winner
  FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)
                  AS frame FROM lineitem)
)"""

DURATION = """
snaps_d AS (
  SELECT s.*, d.duration FROM snapshots s
  JOIN (SELECT replay_id, max(frame) AS duration FROM snapshots GROUP BY replay_id) d
  USING (replay_id)
)"""

FEATS = ["frame", "quantity", "price", "discount", "tax", "linenumber",
         "enemy_quantity", "enemy_price"]

_sum_cols = ",\n         ".join(f"sum(CAST({c} AS DOUBLE)) AS s{i}" for i, c in enumerate(FEATS))
_tot = " + ".join(f"s{i}" for i in range(len(FEATS)))
_theta = ",\n         ".join(
    f"ln(s{i} + 1.0) - ln(tot + {float(len(FEATS))}) AS t{i}" for i in range(len(FEATS)))
_dot = " + ".join(f"x.{c} * p.t{i}" for i, c in enumerate(FEATS))

SPLITS = f"""
expl AS (
  SELECT s.*, CAST(t.test_set AS INTEGER) AS test_set,
         CASE WHEN {h('t.test_set', 's.row_key')} % 1000 < 700 THEN 'train' ELSE 'test' END AS part
  FROM snapshots s CROSS JOIN (SELECT range AS test_set FROM range(1, 6)) t
),
train AS (SELECT * FROM expl WHERE part = 'train'),
test AS (SELECT * FROM expl WHERE part = 'test')"""

NB_PARAMS = f"""
nb_sums AS (
  SELECT test_set, winner, count(*) AS n_c,
         {_sum_cols}
  FROM train GROUP BY test_set, winner
),
nb_params AS (
  SELECT test_set, winner, n_c,
         ln(n_c + 1.0) - ln(sum(n_c) OVER (PARTITION BY test_set)
                            + 1.0 * count(*) OVER (PARTITION BY test_set)) AS pi,
         CAST(row_number() OVER (PARTITION BY test_set ORDER BY n_c DESC, winner) - 1
              AS INTEGER) AS label_idx,
         {_theta}
  FROM (SELECT *, {_tot} AS tot FROM nb_sums)
)"""

PREDICTIONS = f"""
{SPLITS},
{NB_PARAMS},
nb_pred AS (
  SELECT row_key, test_set, winner_p AS nb_pred FROM (
    SELECT x.row_key, x.test_set, p.winner AS winner_p,
           row_number() OVER (PARTITION BY x.row_key, x.test_set
                              ORDER BY p.pi + ({_dot}) DESC, p.label_idx) AS rn
    FROM test x JOIN nb_params p USING (test_set)) WHERE rn = 1
),
maj AS (
  SELECT test_set, winner AS maj FROM (
    SELECT test_set, winner, row_number() OVER (PARTITION BY test_set
                                                ORDER BY count(*) DESC, winner) AS rn
    FROM train GROUP BY test_set, winner) WHERE rn = 1
),
scored AS (
  SELECT t.*, m.maj, n.nb_pred FROM test t JOIN maj m USING (test_set)
  JOIN nb_pred n USING (row_key, test_set)
),
predictions AS (
  SELECT row_key, test_set, frame, winner, 'MAJ' AS classifier, maj AS prediction FROM scored
  UNION ALL SELECT row_key, test_set, frame, winner, 'NB', nb_pred FROM scored
  UNION ALL SELECT row_key, test_set, frame, winner, 'QTY',
         CASE WHEN quantity > 25 THEN 'O' ELSE 'F' END FROM scored
  UNION ALL SELECT row_key, test_set, frame, winner, 'TAX',
         CASE WHEN tax > 0.04 THEN 'O' ELSE 'F' END FROM scored
  UNION ALL SELECT row_key, test_set, frame, winner, 'PRICE',
         CASE WHEN price > 45000 THEN 'O' ELSE 'F' END FROM scored
  UNION ALL SELECT row_key, test_set, frame, winner, 'HASH',
         CASE WHEN {h('test_set')} % 2 = 1 THEN 'O' ELSE 'F' END FROM scored
)"""

CUTOFFS = "cutoffs AS (SELECT unnest([" + ", ".join(str(c) for c in ADAPTER_CUTOFFS) + "]) AS cutoff)"

CURVE = """
curve AS (
  SELECT classifier, test_set, cutoff, count(*) AS n,
         CAST(sum(CASE WHEN prediction = winner THEN 1 ELSE 0 END) AS BIGINT) AS correct,
         CAST(sum(CASE WHEN prediction = winner THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
  FROM predictions JOIN cutoffs ON frame < cutoff
  GROUP BY classifier, test_set, cutoff
)"""

# measures: one row per (test_set, cutoff, classifier) = the study's full measures table
MEASURES = f"""{PREDICTIONS},
{CUTOFFS},
{CURVE}"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()
