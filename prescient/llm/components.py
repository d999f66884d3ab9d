"""Connected components of a link table by contraction to random neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): equal labels, one component.

    Each round gives every node a fresh random priority and merges it into its
    neighbour of least priority, if that is less than its own; the links between
    what was merged go, the rest are renamed. A round leaves about half of the
    nodes at most, chains included, so the rounds grow with the logarithm of the
    largest component. A node's neighbours are only aggregated, never gathered.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
                    .where("u <> v").distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        p = F.xxhash64(F.lit(turn), F.col("v"))
        to = written(edges.groupBy("u").agg(F.min(p).alias("p"), F.min_by("v", p).alias("v"))
                     .select("u", F.when(F.col("p") < F.xxhash64(F.lit(turn), F.col("u")),
                                         F.col("v")).otherwise(F.col("u")).alias("m")), "merged")
        step = to.toDF("label", "m")
        labels = to.toDF("node", "label") if labels is None else \
            labels.join(step, "label", "left").select("node", F.coalesce("m", "label").alias("label"))
        edges = written(edges.join(to, "u").select(F.col("m").alias("mu"), "v")
                        .join(to.toDF("v", "mv"), "v").where("mu <> mv")
                        .select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.toDF("node", "label")
    return written(labels, "labels")
