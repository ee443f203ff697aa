"""Fill missing values with statistics fitted on a training table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.quantiles import exact_quantiles


def most_frequent(df: DataFrame, names: list[str]) -> dict[str, object]:
    """Most frequent value per column, ties to the smallest.

    Counts are combined on the map side; the driver gets one value a column.
    """
    found: dict[str, object] = {}
    for c in names:
        top = df.where(~C.is_missing(df, c)).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        row = top.orderBy(F.desc("n"), "v").limit(1).collect()
        found[c] = row[0]["v"] if row else None
    return found


def fit_imputer(df: DataFrame, numeric: list[str], categorical: list[str], strategy: str = "median") -> dict[str, object]:
    """Fill value per column; ``None`` where a column has no value at all."""
    fills: dict[str, object] = {}
    if numeric:
        if strategy == "median":
            fills = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
        elif strategy == "mean":
            fills = C.wide_aggregate(df, [F.avg(C.as_number(df, c)).alias(c) for c in numeric])
        elif strategy in ("mode", "most_frequent"):
            fills = most_frequent(df, numeric)
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
    fills.update(most_frequent(df, categorical))
    return fills


def apply_imputer(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    out = {}
    for c, value in fills.items():
        if value is None:
            continue
        if c in C.string_columns(df):
            out[c] = F.coalesce(F.col(c), F.lit(value))
        else:
            out[c] = F.coalesce(C.as_number(df, c), C.literal(value))
    return df.withColumns(out) if out else df


def fill_values(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """The fitted state as rows."""
    rows = [(c, None if v is None else str(v)) for c, v in fills.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, fill string")


def missing_after(df: DataFrame, names: list[str]):
    """Cells still missing, as one expression for a total."""
    return reduce(lambda a, b: a + b, [F.count_if(C.is_missing(df, c)) for c in names])
