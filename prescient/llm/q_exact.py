"""Query of the exact dedup operator."""

from prescient.llm.common import table
from prescient.llm.exact_dedup import exact_dedup
from prescient.llm.registry import query

#: A-Z to lower case in DuckDB, other letters as they are.
SQL_LOWER = ("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_NORM = SQL_LOWER.format("coalesce(text, '')")


@query("op7_exact_dedup", f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
