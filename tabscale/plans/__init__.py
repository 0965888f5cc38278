"""Fixtures derived from the given tables, end-to-end workflows, and the
query registry used by ``__spark_entry__``."""
