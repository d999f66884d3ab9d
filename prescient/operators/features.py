"""Feature stages (pyspark.ml): indexers, assembler, vector indexer, formula.

The study chains: index pairing, index label, assemble 28 columns, mark
slots with at most 6 distinct values as categorical, then the learner.
``build_stages`` returns that chain for any feature list; each stage is
fitted by Spark over the whole training table (distributed counts).
"""

from __future__ import annotations

from pyspark.ml.feature import (IndexToString, RFormula, StringIndexer, VectorAssembler,
                                VectorIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescient.sources.snapshots import NUMERIC_FEATURES

LABEL = "winner"
LABEL_IDX = "indexedWinner"
CATEGORY = "races"
CATEGORY_IDX = "indexedRaces"
FEATURES = "features"
INDEXED_FEATURES = "indexedFeatures"
# Fixed value of the study: slots with at most 6 distinct values are categorical.
MAX_CATEGORIES = 6

MODEL_INPUTS = NUMERIC_FEATURES + [CATEGORY_IDX]


def indexers(handle_invalid: str = "error") -> list:
    return [
        StringIndexer(inputCol=CATEGORY, outputCol=CATEGORY_IDX,
                      stringOrderType="frequencyDesc", handleInvalid=handle_invalid),
        StringIndexer(inputCol=LABEL, outputCol=LABEL_IDX,
                      stringOrderType="frequencyDesc", handleInvalid=handle_invalid),
    ]


def assembler(inputs: list[str] | None = None, out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs or MODEL_INPUTS), outputCol=out,
                           handleInvalid="error")


def vector_indexer(max_categories: int = MAX_CATEGORIES) -> VectorIndexer:
    return VectorIndexer(inputCol=FEATURES, outputCol=INDEXED_FEATURES,
                         maxCategories=max_categories)


def build_stages(inputs: list[str] | None = None, handle_invalid: str = "error") -> list:
    """index pairing, index label, assemble, vector-index: the shared prefix."""
    return [*indexers(handle_invalid), assembler(inputs), vector_indexer()]


def fold_stages(inputs: list[str] | None = None) -> list:
    """``build_stages`` for a part of the rows: a pairing, or a value of a categorical
    slot, that only other rows have becomes a category of its own."""
    pairing, label = indexers()
    return [pairing.setHandleInvalid("keep"), label, assembler(inputs),
            vector_indexer().setHandleInvalid("keep")]


def columns(inputs: list[str] | None = None) -> list[str]:
    """The columns that the shared stages read."""
    return [*(c for c in inputs or MODEL_INPUTS if c != CATEGORY_IDX), CATEGORY, LABEL]


def label_converter(labels: list[str], inp: str = "prediction",
                    out: str = "predictedLabel") -> IndexToString:
    return IndexToString(inputCol=inp, outputCol=out, labels=labels)


def rformula(formula: str) -> RFormula:
    return RFormula(formula=formula, featuresCol="features", labelCol="label",
                    stringIndexerOrderType="frequencyDesc")


def vector_slots(df: DataFrame, vec_col: str, keep: list[str]) -> DataFrame:
    """Explode a vector column into (slot, value) rows (keeps ``keep`` columns)."""
    return (df.select(*keep, F.posexplode(vector_to_array(vec_col)).alias("slot", "value")))
