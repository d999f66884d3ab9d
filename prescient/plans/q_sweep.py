"""Queries over scored predictions: accuracy, confusion, the cutoff sweep."""

from __future__ import annotations

from prescient.functions.frames import ADAPTER_CUTOFFS
from prescient.operators import sweep
from prescient.plans import inputs
from prescient.plans.oracle import MEASURES, SNAPSHOTS, with_
from prescient.plans.registry import query, r6
from prescient.session import cut_lineage


def curve(spark, sf_dir):
    """Accuracy per (classifier, test_set, cutoff) from one scoring pass (lazy)."""
    return sweep.accuracy_curve_wide(inputs.scored(spark, sf_dir), inputs.CLASSIFIERS,
                                     ADAPTER_CUTOFFS, ["test_set"])


def measures(spark, sf_dir):
    """The measures table, computed once and checkpointed.

    Its size is classifiers x splits x cutoffs, but it costs a full scoring
    pass; every statistic downstream reads it several times (ranks, pairs,
    sums), so its lineage is cut with a reliable checkpoint in the shared
    checkpoint folder (the study likewise wrote it once and re-read it).
    """
    return cut_lineage(curve(spark, sf_dir))


@query("early_accuracy_curve", with_(SNAPSHOTS, MEASURES) + """
SELECT classifier, test_set, cutoff, n, correct, round(accuracy, 6) AS accuracy FROM curve""")
def early_accuracy_curve(spark, sf_dir):
    """Scan -> adapter -> 5 hash splits -> NB fit -> score once -> sweep 20 cutoffs."""
    return curve(spark, sf_dir).withColumn("accuracy", r6("accuracy"))
