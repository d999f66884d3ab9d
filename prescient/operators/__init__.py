"""Operators on DataFrames: preparation, splits, features, learners, KNN,
the cutoff sweep, summaries and significance tests."""
