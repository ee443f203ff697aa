"""Registry of queries with their SQL equivalents, and output conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loomframe.functions.columns import FLOAT_TYPES, INTEGER_TYPES
from loomframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; its columns get the common types."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: settle(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """bigint, rounded double, string and boolean columns only."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, INTEGER_TYPES):
            column = column.cast("bigint")
        elif isinstance(field.dataType, FLOAT_TYPES + (T.DecimalType,)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            column = F.date_format(column.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)


# Text helpers for the SQL side, so that both sides round and print alike.


def num(expr: str, name: str) -> str:
    return f'round(cast({expr} as double), 6) + 0.0 as "{name}"'


def whole(expr: str, name: str) -> str:
    return f'cast({expr} as bigint) as "{name}"'


def stamp(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') as \"{name}\""


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)
