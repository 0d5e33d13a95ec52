"""Readers and writers: Parquet, CSV and JSON."""
