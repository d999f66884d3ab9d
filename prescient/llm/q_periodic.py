"""Query of periodic run detection."""

from pyspark.sql import functions as F

from prescient.llm.common import WORD_PATTERN, table
from prescient.llm.periodic import collapse_runs
from prescient.llm.registry import query


def planted(docs):
    """``docs`` with a repetition in one of ten: with h the crc32 of the id as text and
    g = floor(h / 10), the n words of a row with h % 10 = 0 are, from word a = g % n on,
    the words a to a + p - 1 over and over, p = 1 + floor((n - a) / (3 + g % 8)). A row
    without an id, or without words, stays as it is."""
    h = "crc32(cast(cast(doc_id as string) as binary))"
    words = docs.select("doc_id", "text", F.expr(f"if({h} % 10 = 0, {h} div 10, null)").alias("g")) \
        .withColumn("w", F.when(F.col("g").isNotNull() & F.col("text").isNotNull(),
                                F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))) \
        .withColumn("n", F.size("w")) \
        .withColumn("a", F.expr("if(n > 0, g % n, null)")) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0, n - 1), i -> "
                  "w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return words.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    found = collapse_runs(planted(table(spark, sf_dir, "documents")), F.col("doc_id"))
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> if(b is null or r.length > b.length, r, b))""")
    lines = F.expr("""array_join(transform(runs, r -> concat(
        r.start, ',', r.length, ',', r.period, '\n')), '')""")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
