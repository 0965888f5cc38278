"""Operators for large training-text corpora (one module per operator).

Nothing else in the library imports this subpackage; ``queries.py`` registers
one query per operator and ``__spark_entry__.py`` adds them when present.
"""
