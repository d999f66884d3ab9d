"""Query of benchmark decontamination."""

from pyspark.sql import functions as F

from prescient.llm.common import table
from prescient.llm.decontaminate import find_leaks
from prescient.llm.q_exact import SQL_LOWER
from prescient.llm.registry import query

_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op12_decontaminate", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             {_WORDS.format(SQL_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS id,
        {_WORDS.format(SQL_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
g AS (SELECT DISTINCT id, least(len(w), 10) AS k,
        array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
      FROM b, range(1, greatest(len(w) - 8, 2)) t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM g),
x AS (SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
      FROM d, k, range(1, len(w) - k + 2) t(i)),
h AS (SELECT x.r, x.i, x.k, g.id FROM x JOIN g USING (k, g)),
n AS (SELECT r, count(DISTINCT j) AS n_hit
      FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, id FROM h WHERE id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)""")
def op12_decontaminate(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                       F.col("doc_id"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
