"""Query of language-model scoring."""

from pyspark.sql import functions as F

from prescient.llm import katz
from prescient.llm.common import crc_bucket, table
from prescient.llm.registry import query


@query("op8_katz")
def op8_katz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    train = crc_bucket(F.col("doc_id"), 7) != 2
    scores, model = katz.score(docs.select("doc_id", "text", train.alias("train")))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.words.n).cast("long").alias("train_tokens"),
                         "base_score", "score")
