"""Readers: parquet tables, JSON dumps, CSV labels, HTML pages."""
