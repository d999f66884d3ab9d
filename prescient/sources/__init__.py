"""Scans and sinks: parquet tables, snapshot CSVs, result folders."""
