"""The registry of named queries with their SQL, and what their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.schema import Chart, View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TAG, COLUMNS, WEIGHT = "view", 60, 0.6
CHART = Chart(TAG, smoothing=WEIGHT, px_w=COLUMNS, px_h=40)
ZOOMED = View(0.25, 0.5)
POINTS = ("run", "tag", "step", "wall", "value")


def query(sql: str | None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def points_sql(n: int = 4) -> str:
    return f"""p AS (SELECT 'u' || (user_id % {n}) AS run, event_type AS tag, event_id AS step,
  epoch_us(ts) / 1e6::DOUBLE AS wall, value FROM events)"""


P, P12 = points_sql(), points_sql(12)

#: Points as event files hold them.
STORED = f"WITH {P} SELECT run, tag, step, wall, value::FLOAT::DOUBLE AS value FROM p"
