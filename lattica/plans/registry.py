"""Registered queries of the library and their SQL oracles, named by survey id and a word."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
BIAS = 1.3e-10
MODULES = ("graph_queries", "manifold_queries", "clustering_queries", "run_queries")


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows where there is one."""

    def put(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"lattica.plans.{m}")


def r(x: str) -> str:
    """Rounded to six decimals, without a negative zero; BIAS keeps halves from falling either way."""
    return f"(round({x} + {BIAS}, 6) + 0.0)"


def rounded(x, alias: str):
    from pyspark.sql import functions as F

    return (F.round((F.col(x) if isinstance(x, str) else x) + F.lit(BIAS), 6) + F.lit(0.0)).alias(alias)
