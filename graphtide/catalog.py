"""Registered queries of the knowledge-graph operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphtide.plans.fixtures import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a function of the derived inputs as a query."""

    def wrap(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return wrap


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rk_standard"](spark, sf_dir)


from graphtide.plans import queries_graph  # noqa: E402, F401
from graphtide.plans import queries_rank  # noqa: E402, F401
from graphtide.plans import queries_text  # noqa: E402, F401
from graphtide.plans import queries_stream  # noqa: E402, F401
