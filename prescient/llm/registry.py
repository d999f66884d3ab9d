"""Registry of the corpus queries and their DuckDB statements."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return add
