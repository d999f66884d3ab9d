"""Query of language identification."""

from pyspark.sql import functions as F

from prescient.llm import langid
from prescient.llm.common import crc_bucket, table
from prescient.llm.registry import query


@query("op10_langid")
def op10_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))
