"""Registry of the runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.plans.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: From here on a double's sixth decimal is noise; NaN and infinities compare as larger than it in both engines.
UNROUNDED = 1e9


def r6(value):
    """Six decimals, computed with the same arithmetic in Spark and in SQL.

    The small excess over one half keeps decimal ties on one side in both. Values of at least ``UNROUNDED`` in size, NaN and
    infinities pass unchanged, nulls stay null, and a negative zero becomes zero.
    """
    rounded = F.floor(value * F.lit(1e6) + F.lit(0.5003)) / F.lit(1e6)
    return F.when(F.abs(value) >= F.lit(UNROUNDED), value).otherwise(rounded)


def tidy(df: DataFrame) -> DataFrame:
    """Result columns in plain types: BIGINT, DOUBLE at six decimals, STRING, BOOLEAN."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = r6(column.cast("double"))
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


def _needed_views(text: str) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in SQL_VIEWS:
            if other != name and re.search(rf"\b{other}\b", SQL_VIEWS[name]):
                if other not in ordered:
                    visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in SQL_VIEWS:
        if re.search(rf"\b{name}\b", text) and name not in ordered:
            visit(name)
    return ordered


def build_sql(body: str, ctes: str = "", dbl: str = "", big: str = "") -> str:
    """Prefix the view definitions ``body`` uses and fix the result types."""
    views = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in _needed_views(body + " " + ctes)]
    parts = views + ([ctes] if ctes.strip() else [])
    rounded = "CASE WHEN abs(CAST({0} AS DOUBLE)) >= 1e9 THEN CAST({0} AS DOUBLE) ELSE floor(CAST({0} AS DOUBLE) * 1e6 + CAST(0.5003 AS DOUBLE)) / 1e6 END AS {0}"
    fixes = [rounded.format(c) for c in dbl.split()]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
    star = f"* REPLACE ({', '.join(fixes)})" if fixes else "*"
    recursive = "RECURSIVE " if "rec" in ctes else ""
    head = f"WITH {recursive}{', '.join(parts)} " if parts else ""
    return f"{head}SELECT {star} FROM ({body}) AS result"


def query(name: str, sql: str | None = None, ctes: str = "", dbl: str = "", big: str = ""):
    """Register ``fn(views) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = build_sql(sql, ctes, dbl, big)
        return fn

    return wrap
