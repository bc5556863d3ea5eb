"""All registered driver queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratestat.plans.common import finalize
from ratestat.session import tune_session

_MODULES = ["ratestat.plans.q_clean", "ratestat.plans.q_tests", "ratestat.plans.q_models",
            "ratestat.plans.q_charts", "ratestat.plans.q_wide", "ratestat.plans.q_io"]


def _load():
    queries, sql = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def _finalized(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune_session(spark)
        return finalize(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q, _ = _load()
    return {k: _finalized(v) for k, v in q.items()}


def oracle_sql() -> dict[str, str]:
    q, s = _load()
    return {k: v for k, v in s.items() if k in q}
