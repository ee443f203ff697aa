"""Outlier detection and handling on numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.quantiles import exact_quantiles


def iqr_fences(df: DataFrame, names: list[str], factor: float = 1.5, guarded: bool = True) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column.

    ``guarded`` leaves out columns with fewer than four values or no spread,
    as detection does; clipping uses the plain fences.
    """
    quartiles = exact_quantiles(df, names, [0.25, 0.75])
    counts = C.wide_aggregate(df, [F.count(C.as_number(df, c)).alias(c) for c in names]) if guarded else {}
    fences = {}
    for c in names:
        q1, q3 = quartiles[c]
        if q1 is None or (guarded and (counts[c] < 4 or q3 == q1)):
            continue
        spread = q3 - q1
        fences[c] = (q1 - factor * spread, q3 + factor * spread)
    return fences


def _outside(df: DataFrame, name: str, fence: tuple[float, float]) -> Column:
    value = C.as_number(df, name)
    return (value < fence[0]) | (value > fence[1])


def iqr_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Outliers per column and their share of the non-missing values."""
    fences = iqr_fences(df, names)
    exprs, rows = [], []
    for i, c in enumerate(names):
        exprs.append(F.count(C.as_number(df, c)).alias(f"n{i}"))
        exprs.append((F.count_if(_outside(df, c, fences[c])) if c in fences else F.sum(F.lit(0))).alias(f"o{i}"))
        found = F.coalesce(F.col(f"o{i}"), F.lit(0))
        rows.append({"column_name": F.lit(c), "n_outliers": found, "ratio": C.safe_divide(found, F.col(f"n{i}"))})
    return C.inline_rows(df.agg(*exprs), rows)


def iqr_rows(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, column, value) of every value outside its fence, in one pass."""
    fences = iqr_fences(df, names)
    return _flagged(df, key, {c: _outside(df, c, f) for c, f in fences.items()})


def _flagged(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    if not tests:
        return df.select(F.col(key), F.lit("").alias("column_name"), F.lit(0.0).alias("value")).where("false")
    hits = F.array(
        *[F.when(t, F.struct(F.lit(c).alias("column_name"), C.as_number(df, c).alias("value"))) for c, t in tests.items()]
    )
    return df.select(F.col(key), F.inline(F.filter(hits, lambda h: h.isNotNull())))


def zscore_tests(df: DataFrame, names: list[str], threshold: float = 3.0) -> dict[str, Column]:
    exprs = []
    for c in names:
        exprs += [F.avg(C.as_number(df, c)).alias(f"{c}__m"), F.stddev_samp(C.as_number(df, c)).alias(f"{c}__s")]
    found = C.wide_aggregate(df, exprs)
    tests = {}
    for c in names:
        mean, std = found[f"{c}__m"], found[f"{c}__s"]
        if std:
            tests[c] = F.abs((C.as_number(df, c) - F.lit(mean)) / F.lit(std)) > threshold
    return tests


def zscore_rows(df: DataFrame, key: str, names: list[str], threshold: float = 3.0) -> DataFrame:
    return _flagged(df, key, zscore_tests(df, names, threshold))


def remove_outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with no value outside a fence.

    The flag is a function of the row, so this is a filter over the scan
    rather than an anti join on flagged keys.
    """
    fences = iqr_fences(df, names)
    if not fences:
        return df
    bad = reduce(Column.__or__, [F.coalesce(_outside(df, c, f), F.lit(False)) for c, f in fences.items()])
    return df.where(~bad)


def drop_rows(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``flagged`` (ids found by any detector)."""
    return df.join(flagged.select(key).distinct(), key, "left_anti")


def clip_outliers(df: DataFrame, names: list[str], fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values clamped to fences fitted here or passed from the training table."""
    fences = fences if fences is not None else iqr_fences(df, names, guarded=False)
    out = {}
    for c in names:
        if c in fences:
            low, high = fences[c]
            value = C.as_number(df, c)
            out[c] = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
    return df.withColumns(out) if out else df


def robust_transform(df: DataFrame, names: list[str]) -> DataFrame:
    """Handling by scaling: (x - median) / IQR."""
    from loomframe.operators.scale import apply_scaler, fit_scaler

    return apply_scaler(df, fit_scaler(df, names, "robust"))
