"""Query of the mixing operator."""

from pyspark.sql import functions as F

from prescient.llm.common import table
from prescient.llm.mixing import mix
from prescient.llm.registry import query


@query("op1_mix")
def op1_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
