"""Loads every corpus query."""

from prescient.llm import (  # noqa: F401
    q_chat,
    q_exact,
    q_lang,
    q_leaks,
    q_lm,
    q_mix,
    q_near,
    q_periodic,
    q_quality,
    q_search,
    q_spelling,
    q_tokens,
)
from prescient.llm.registry import ORACLE, QUERIES  # noqa: F401
