"""Every query of the engine by name, with the SQL it is held against."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
FLAGSHIP = "feature_bins_mean"
MODULES = ("id_queries", "matrix_queries", "interval_queries", "bin_queries", "sequence_queries", "annotation_queries", "statistics_queries", "genome_queries", "format_queries", "dialect_queries")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"stratalane.plans.{name}")
