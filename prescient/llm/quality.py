"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts writes some forty statistics of each document; the
labelled ones among them are joined by id and a bounded sample of these rows,
drawn by a hash of the id (one row an id, at most SAMPLE_ROWS), fits the trees on
the driver. The flat trees are
broadcast and score every document's statistics in numpy.

Defined results: null text counts as empty and has a score like any other. A
document without a label is scored only. Labels repeated for an id count once,
the smallest; null labels and labels of unknown ids are not learned from. Of
the rows of one id the one with the smallest statistics is learned from, whatever
their number; each has its own score, rows of equal texts the same. Without labelled rows every score is
0.5. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.boosting import Trees, fit
from prescient.llm.common import slices, written
from prescient.llm.textstats import NAMES, statistics
from prescient.session import ready

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 60_000
#: Score from which label 1 is predicted.
CUT = 0.3


def _statistics(batches):
    for b in slices(batches):
        x = statistics(b.column("text"))
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())],
            names=[*keep, "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of ``docs`` (doc_id, text); stats holds NAMES as float32."""
    ready(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_statistics, "doc_id long, stats binary"), "statistics")


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit to the documents of ``stats`` that ``labels`` (doc_id, label) marks 0 or 1."""
    marked = labels.where("label in (0, 1) and doc_id is not null") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").alias("label"))
    one = stats.where("doc_id is not null").groupBy("doc_id").agg(F.min("stats").alias("stats"))
    known = written(one.join(marked, "doc_id").withColumn("h", F.xxhash64("doc_id")), "labelled")
    n = known.count()
    if n > 2 * sample_rows:  # ids are distinct here, so a share of the hashes is one of the rows
        share = (1.2 * sample_rows + 1000) / n
        known = known.where(F.col("h") < F.lit(min(int(2**64 * share), 2**64 - 1) - 2**63))
    rows = known.orderBy("h", "doc_id").limit(sample_rows).select("stats", "label").toPandas()
    x = np.frombuffer(b"".join(rows["stats"]), dtype=np.float32).reshape(-1, len(NAMES))
    return fit(x, rows["label"].to_numpy(dtype=float))


def _score(model):
    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("stats").to_pylist()),
                              dtype=np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))],
                                             names=["doc_id", "score"])
    return rows


def score(stats: DataFrame, model: Trees, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted of every row of ``stats``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)
    return stats.mapInArrow(_score(sent), "doc_id long, score double") \
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))
