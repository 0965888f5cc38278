"""Query registry: key -> (Spark builder(spark, sf_dir), DuckDB oracle SQL or None).

Each Spark builder runs an operator over whole tables (or fixtures Spark
derives from them); each oracle is an independent SQL formulation of the
same semantics. Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all():
    from . import q_clean, q_detect, q_profile, q_features, q_abtest, q_causal, q_models, q_sources  # noqa: F401
    return QUERIES, ORACLES
