"""Categorical encoders with a fitted dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomframe.functions import columns as C
from loomframe.functions.ordering import order_index
from loomframe.session import materialize

OTHER = "other"
# categories that become columns of one table without being asked for
MOST_CATEGORIES = 10_000


def fit_onehot(df: DataFrame, names: list[str], max_categories: int | None = None) -> dict[str, dict]:
    """Sorted categories per column.

    Every category becomes a column, so without ``max_categories`` a column with more
    than MOST_CATEGORIES values is refused; onehot_cells needs no dictionary. With ``max_categories`` only that many of the most frequent are kept (ties to
    the smaller value) and the rest map to ``other``, at fit and at apply time
    alike.  All columns are counted in one shuffle of (column, value) pairs.
    """
    state = {}
    if not names:
        return state
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(names)])
    counts = df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    if max_categories is None:
        counts = materialize(counts, "categories")
        wide = counts.groupBy("i").count().where(F.col("count") > MOST_CATEGORIES).select("i").collect()
        if wide:
            raise ValueError(f"more than {MOST_CATEGORIES} categories in {[names[r['i']] for r in wide]}; name max_categories or use onehot_cells")
    else:
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
        counts = counts.withColumn("rank", rank).where(F.col("rank") <= max_categories + 1)
    found: dict[int, list] = {i: [] for i in range(len(names))}
    for r in counts.orderBy("i", F.desc("n"), "v").collect():
        found[r["i"]].append(r["v"])
    for i, c in enumerate(names):
        top = found[i]
        folded = max_categories is not None and len(top) > max_categories
        kept = top[:max_categories]
        state[c] = {"kept": kept, "folded": folded, "columns": sorted(set(kept) | ({OTHER} if folded else set()))}
    return state


def apply_onehot(df: DataFrame, state: dict[str, dict], unknown: str = "ignore", drop: bool = True) -> DataFrame:
    """0/1 columns ``{column}_{category}``; an unseen value gives all zeros."""
    out = {}
    for c, s in state.items():
        value = F.col(c)
        if s["folded"]:
            value = F.when(value.isin(s["kept"]), value).when(value.isNotNull(), F.lit(OTHER))
        elif unknown == "error":
            refuse = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.col(c)))
            value = F.when(value.isNull() | value.isin(s["kept"]), value).otherwise(refuse)
        for category in s["columns"]:
            out[f"{c}_{category}"] = F.coalesce((value == F.lit(category)).cast("int"), F.lit(0))
    encoded = df.withColumns(out) if out else df
    return encoded.drop(*state) if drop else encoded


def onehot_cells(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Sparse form for any number of categories: (key, feature, category), without a fit."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in names])
    return df.select(key, F.inline(cells)).where(F.col("category").isNotNull())


def onehot_long(df: DataFrame, key: str, state: dict[str, dict]) -> DataFrame:
    """Sparse form: (key, feature, category) for each hot cell only."""
    cells = []
    for c, s in state.items():
        value = F.col(c)
        rest = F.lit(OTHER) if s["folded"] else F.lit(None).cast("string")
        hot = F.when(value.isin(s["kept"]), value).when(value.isNotNull(), rest)
        cells.append(F.struct(F.lit(c).alias("feature"), hot.alias("category")))
    return df.select(key, F.inline(F.array(*cells))).where(F.col("category").isNotNull())


def fit_ordinal(df: DataFrame, column: str) -> DataFrame:
    """Dictionary (value, code): codes follow the sorted values from 0."""
    return materialize(order_index(df, column), "ordinal")


def apply_ordinal(df: DataFrame, column: str, dictionary: DataFrame, out: str | None = None, unknown: str = "error") -> DataFrame:
    """Code of each value by a join on the dictionary.

    Spark broadcasts the dictionary when its measured size allows and falls
    back to a skew-aware sort-merge join when not.
    """
    out = out or f"{column}_code"
    codes = dictionary.select(F.col("value").alias("__value"), F.col("code").alias(out))
    joined = df.join(codes, F.col(column).cast("string") == F.col("__value"), "left").drop("__value")
    if unknown == "error":
        refuse = F.raise_error(F.concat(F.lit(f"unknown category in {column}: "), F.col(column).cast("string")))
        joined = joined.withColumn(out, F.when(F.col(out).isNull() & F.col(column).isNotNull(), refuse).otherwise(F.col(out)))
    return joined


def decode_ordinal(df: DataFrame, code: str, dictionary: DataFrame, out: str) -> DataFrame:
    values = dictionary.select(F.col("code").alias("__code"), F.col("value").alias(out))
    return df.join(values, F.col(code) == F.col("__code"), "left").drop("__code")


def fit_target(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Smoothed mean of the target per category, with the global mean for the unseen."""
    y = C.as_number(df, target)
    overall = df.agg(F.avg(y).alias("m")).first()["m"]
    groups = df.where(y.isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    mean = (F.col("s") + F.lit(smoothing) * C.literal(overall)) / (F.col("n") + F.lit(smoothing))
    return materialize(groups.select("value", "n", mean.alias("encoding"), C.literal(overall).alias("fallback")), "target-encoding")


def apply_target(df: DataFrame, column: str, state: DataFrame, out: str | None = None) -> DataFrame:
    out = out or f"{column}_target"
    fallback = state.select("fallback").first()
    values = state.select(F.col("value").alias("__value"), F.col("encoding").alias(out))
    joined = df.join(values, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")
    return joined.withColumn(out, F.coalesce(F.col(out), C.literal(fallback["fallback"] if fallback else None)))
