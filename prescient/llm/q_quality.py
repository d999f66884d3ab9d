"""Query of the quality classifier."""

from pyspark.sql import functions as F

from prescient.llm import quality
from prescient.llm.common import crc_bucket, table
from prescient.llm.registry import query


@query("op4_quality")
def op4_quality(spark, sf_dir):
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out) \
        .select("doc_id", F.col("quality").alias("label"))
    model = quality.train(stats, labels)
    return quality.score(stats, model) \
        .select("doc_id", held_out.alias("held_out"), "score", "predicted")
