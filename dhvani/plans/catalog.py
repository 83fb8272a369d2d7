"""Query catalog: every operator from the survey as a query over the driver's
tables, each with an independent DuckDB oracle where SQL can express it.

Outputs are scalar columns (arrays are exploded with their positions) and
floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
