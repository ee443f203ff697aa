"""Standard, min-max and robust scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.quantiles import exact_quantiles


def fit_scaler(df: DataFrame, names: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, width) per column; a width of zero becomes one."""
    if method == "robust":
        found = exact_quantiles(df, names, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], None if q[0] is None else q[2] - q[0]) for c, q in found.items()}
    else:
        exprs = []
        for c in names:
            x = C.as_number(df, c)
            if method == "standard":
                exprs += [F.avg(x).alias(f"{c}__a"), F.stddev_pop(x).alias(f"{c}__b")]
            elif method == "minmax":
                exprs += [F.min(x).alias(f"{c}__a"), (F.max(x) - F.min(x)).alias(f"{c}__b")]
            else:
                raise ValueError(f"unknown method {method!r}")
        found = C.wide_aggregate(df, exprs)
        pairs = {c: (found[f"{c}__a"], found[f"{c}__b"]) for c in names}
    return {c: (a, b or 1.0) for c, (a, b) in pairs.items() if a is not None}


def apply_scaler(df: DataFrame, state: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (C.as_number(df, c) - F.lit(a)) / F.lit(b) for c, (a, b) in state.items()})
