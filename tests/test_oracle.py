"""Every query with an oracle statement gives the same rows as DuckDB (sf0.001)."""

import hashlib
import math

import pytest

import __spark_entry__ as entry
from conftest import SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def test_every_query_registered_has_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 70


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"classifier", "test_set", "cutoff", "n", "correct", "accuracy"}
