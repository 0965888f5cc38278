"""Readers (CSV, Parquet, extension dispatch), table metadata, previews, and
sinks (model persistence, report tables)."""
