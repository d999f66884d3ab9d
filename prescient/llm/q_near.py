"""Query of near-duplicate detection."""

from prescient.llm.common import table
from prescient.llm.near_dedup import near_duplicates
from prescient.llm.registry import query


@query("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
