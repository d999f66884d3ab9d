"""Registered queries (Spark) and their DuckDB oracle statements."""


def load_all():
    """Import every query module so the registry is complete."""
    from prescient.plans import (q_analytics, q_knn, q_learn, q_model, q_prep,  # noqa: F401
                                 q_split, q_sweep, q_tune)
    from prescient.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
