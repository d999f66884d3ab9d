"""prescient: early-outcome analytics on PySpark.

Predict the outcome of a two-sided contest from timed snapshots, measure how
early the prediction becomes reliable, and compare classifiers. Everything
runs as Spark jobs on built-in expressions and pyspark.ml.
"""

__version__ = "0.1.0"
