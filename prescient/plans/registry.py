"""Query registry: each query is a Spark callable (spark, sf_dir) -> DataFrame
with, where SQL can state it, the DuckDB statement that must give the same rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prescient.session import ready

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the registered callable first makes
    the session ready (checkpoint folder, package shipped to workers)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ready(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> Column:
    """Round a double to 6 places (the oracle does the same)."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6)
