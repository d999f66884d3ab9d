"""Query of the exact top-k search."""

from pyspark.sql import functions as F

from prescient.llm.common import table
from prescient.llm.maxscore import quantise, top_k
from prescient.llm.registry import query


@query("op6_top_k", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def op6_top_k(spark, sf_dir):
    v = quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(v, v.where(F.col("id") % 50 == 0), k=5)
