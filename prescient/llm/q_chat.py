"""Query of preference formatting."""

from pyspark.sql import functions as F

from prescient.llm.common import table
from prescient.llm.preference import preference_pairs
from prescient.llm.registry import query


def preference_turns(conversations):
    """Stand-in input (pair_id, side, turn, role, text): the chosen side is a
    conversation, the rejected side has the next conversation's last assistant
    text in place of its own last one (empty if there is none)."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    answer = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    text = turns.join(answer, ["conv_id", "turn"]) \
        .groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    other = answer.join(text.select((F.col("conv_id") - 1).alias("conv_id"),
                                    F.col("text").alias("other")), "conv_id", "left") \
        .select("conv_id", F.col("turn").alias("last"), F.coalesce("other", F.lit("")).alias("other"))
    rejected = turns.join(other, "conv_id", "left").select(
        "conv_id", F.lit("rejected").alias("side"), "turn", "role",
        F.when(F.col("turn") == F.col("last"), F.col("other")).otherwise(F.col("text")).alias("text"))
    return turns.select("conv_id", F.lit("chosen").alias("side"), "turn", "role", "text") \
        .unionByName(rejected).withColumnRenamed("conv_id", "pair_id")


def _spans(mask: str):
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")


_SIDE_SQL = """
{0}_t AS (SELECT pair_id, turn, {0}.role AS role, {0}.text AS text,
    coalesce(sum(length(rend({0}.role, {0}.text))) OVER (PARTITION BY pair_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM cut WHERE turn >= first_other AND {0} IS NOT NULL),
{0}_s AS (SELECT pair_id, string_agg(rend(role, text), '' ORDER BY turn) AS text,
    string_agg((pos + length(role) + 5)::BIGINT::VARCHAR || ':' ||
               (pos + length(role) + 5 + length(text) + 8)::BIGINT::VARCHAR, ',' ORDER BY turn)
      FILTER (WHERE role = 'assistant') AS mask
  FROM {0}_t GROUP BY pair_id)"""

_SQL = """
WITH a AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant'
           GROUP BY conv_id),
lt AS (SELECT a.conv_id, a.turn, min(c.text) AS text FROM a JOIN conversations c
       ON c.conv_id = a.conv_id AND c.turn = a.turn GROUP BY 1, 2),
o AS (SELECT a.conv_id, a.turn AS last, coalesce(n.text, '') AS other
      FROM a LEFT JOIN lt n ON n.conv_id = a.conv_id + 1),
l AS (SELECT c.conv_id AS pair_id, c.turn,
        min({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}}) AS c,
        min({{'role': coalesce(role, 'user'), 'text': coalesce(CASE WHEN c.turn = o.last
             THEN o.other ELSE text END, '')}}) AS r
      FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id
      WHERE c.conv_id IS NOT NULL GROUP BY 1, 2),
cut AS (SELECT *, coalesce(min(CASE WHEN c IS DISTINCT FROM r THEN turn END)
                           OVER (PARTITION BY pair_id), 9223372036854775807) AS first_other
        FROM l),{c},{r},
p AS (SELECT pair_id, (count(*) FILTER (WHERE turn < first_other))::INT AS prompt_turns,
        coalesce(string_agg(rend(c.role, c.text), '' ORDER BY turn)
                 FILTER (WHERE turn < first_other), '') AS prompt
      FROM cut GROUP BY pair_id)
SELECT p.pair_id, prompt_turns, prompt, coalesce(c_s.text, '') AS chosen,
  coalesce(c_s.mask, '') AS chosen_mask, coalesce(r_s.text, '') AS rejected,
  coalesce(r_s.mask, '') AS rejected_mask,
  c_s.mask IS NOT NULL AND r_s.mask IS NOT NULL AS usable
FROM p LEFT JOIN c_s USING (pair_id) LEFT JOIN r_s USING (pair_id)"""


def _sql() -> str:
    import re
    sql = _SQL.format(c=_SIDE_SQL.format("c"), r=_SIDE_SQL.format("r"))
    return re.sub(r"rend\((.*?), (.*?)\)", r"('<|' || \1 || '|>' || chr(10) || \2 || '<|end|>' || chr(10))",
                  sql)


@query("op9_preference", _sql())
def op9_preference(spark, sf_dir):
    turns = preference_turns(table(spark, sf_dir, "conversations"))
    return preference_pairs(turns) \
        .withColumn("chosen_mask", _spans("chosen_mask")) \
        .withColumn("rejected_mask", _spans("rejected_mask"))
