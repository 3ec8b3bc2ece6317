"""All registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import extraction

_MODULES = ["extraction", "quality", "splitting", "evaluation", "modelling", "reporting", "sources", "incremental"]


def _loaded():
    mods = []
    for m in _MODULES:
        try:
            mods.append(importlib.import_module(f"{__package__}.{m}"))
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return mods


def queries():
    out = {}
    for m in _loaded():
        out.update(m.QUERIES)
    return out


def _bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's ``count_if`` is BIGINT.
    Wrap every ``count_if(...)`` of our oracle text in a BIGINT cast."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(count_if(" + _bigint_counts(sql[j + len(key):k]) + ") AS BIGINT)")
        i = k + 1


def oracle_sql():
    out = {}
    for m in _loaded():
        out.update(getattr(m, "SQL", {}))
    return {k: _bigint_counts(v) for k, v in out.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.q_event_window_wide(spark, sf)
