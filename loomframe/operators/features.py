"""Date parts, polynomial terms and feature selection."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomframe.functions import columns as C
from loomframe.functions.quantiles import exact_quantiles

# The formats of text dates, in the order they are tried.
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd"]


def parse_date_text(text: Column) -> Column:
    """The first date found in a text, by the four known shapes."""
    shapes = zip([r"(\d{4}-\d{2}-\d{2})", r"(\d{2}/\d{2}/\d{4})", r"(\d{2}-\d{2}-\d{4})", r"(\d{4}/\d{2}/\d{2})"], DATE_FORMATS)
    tries = [F.try_to_timestamp(F.regexp_extract(text, shape, 1), F.lit(form)) for shape, form in shapes]
    return F.coalesce(*tries)


def expand_datetime(df: DataFrame, names: list[str], drop: bool = True) -> DataFrame:
    """Year, month, day, weekday (Monday 0), hour and minute columns."""
    out = {}
    for c in names:
        when = parse_date_text(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
        stamp = when.cast("timestamp")
        for part, value in (
            ("year", F.year(stamp)),
            ("month", F.month(stamp)),
            ("day", F.day(stamp)),
            ("dayofweek", F.weekday(stamp)),
            ("hour", F.hour(stamp)),
            ("minute", F.minute(stamp)),
        ):
            out[f"{c}_{part}"] = value
    expanded = df.withColumns(out) if out else df
    return expanded.drop(*names) if drop else expanded


def polynomial_terms(names: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> dict[str, list[str]]:
    """Name of each term and the columns it multiplies."""
    terms: dict[str, list[str]] = {"1": []} if bias else {}
    pick = combinations if interaction_only else combinations_with_replacement
    for size in range(1, degree + 1):
        for group in pick(names, size):
            powers = Counter(group)
            label = " ".join(n if k == 1 else f"{n}^{k}" for n, k in powers.items())
            terms[label] = list(group)
    return terms


def polynomial_features(
    df: DataFrame,
    names: list[str] | None = None,
    degree: int = 2,
    interaction_only: bool = False,
    bias: bool = False,
    max_features: int | None = None,
    max_inputs: int | None = None,
) -> DataFrame:
    """Products and powers next to the original columns, nulls as medians.

    With ``max_features`` the terms with the highest variance stay; with
    ``max_inputs`` only the first inputs are multiplied.
    """
    return apply_polynomial(df, fit_polynomial(df, names, degree, interaction_only, bias, max_features, max_inputs))


@dataclass(frozen=True)
class Polynomial:
    """The kept terms and, for columns with gaps, the medians that fill them."""

    terms: dict[str, list[str]]
    medians: dict[str, float]


def fit_polynomial(
    df: DataFrame,
    names: list[str] | None = None,
    degree: int = 2,
    interaction_only: bool = False,
    bias: bool = False,
    max_features: int | None = None,
    max_inputs: int | None = None,
) -> Polynomial:
    """Everything that ``apply_polynomial`` needs, found on the table given here only."""
    names = (names or C.numeric_columns(df))[:max_inputs]
    medians = {c: q[0] for c, q in exact_quantiles(df, names, [0.5]).items() if q[0] is not None}
    state = Polynomial(polynomial_terms(names, degree, interaction_only, bias), medians)
    if max_features is not None and len(state.terms) > max_features:
        spread = C.wide_aggregate(df, [F.var_pop(v).alias(f"t{i}") for i, v in enumerate(_products(df, state).values())])
        ranked = sorted(enumerate(state.terms), key=lambda p: (-(spread[f"t{p[0]}"] or 0.0), p[0]))
        kept = {label for _, label in ranked[:max_features]}
        state = Polynomial({k: v for k, v in state.terms.items() if k in kept}, medians)
    return state


def _products(df: DataFrame, state: Polynomial) -> dict[str, Column]:
    products = {}
    for label, group in state.terms.items():
        value = F.lit(1.0)
        for c in group:
            number = C.as_number(df, c)
            value = value * (F.coalesce(number, C.literal(state.medians[c])) if c in state.medians else number)
        products[label] = value
    return products


def apply_polynomial(df: DataFrame, state: Polynomial) -> DataFrame:
    """A projection: no job, so it also runs on a stream."""
    return df.withColumns({k: v for k, v in _products(df, state).items() if k not in df.columns})


def variances(df: DataFrame, names: list[str]) -> DataFrame:
    row = df.agg(*[F.var_pop(C.as_number(df, c)).alias(f"v{i}") for i, c in enumerate(names)])
    return C.inline_rows(row, [{"column_name": F.lit(c), "score": F.col(f"v{i}")} for i, c in enumerate(names)])


def select_variance(df: DataFrame, names: list[str], threshold: float = 0.01) -> DataFrame:
    """Scores with the columns that pass the variance threshold marked."""
    return variances(df, names).withColumn("selected", F.col("score") > threshold)


def f_classif(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """One-way ANOVA F per feature; group sums are combined map-side.

    Values are centred on their mean first, which keeps the sums of squares
    from cancelling on long columns.
    """
    means = C.wide_aggregate(df, [F.avg(C.as_number(df, c)).alias(c) for c in names])
    exprs = []
    for i, c in enumerate(names):
        x = C.as_number(df, c) - C.literal(means[c])
        exprs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    groups = df.where(F.col(target).isNotNull()).groupBy(target).agg(*exprs)
    cells = [{"column_name": F.lit(c), "n": F.col(f"n{i}"), "s": F.col(f"s{i}"), "q": F.col(f"q{i}")} for i, c in enumerate(names)]
    long = C.inline_rows(groups, cells).where("n > 0")
    sums = long.groupBy("column_name").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"), F.count(F.lit(1)).alias("k")
    )
    s, q, n, g, k = (F.col(c) for c in "sqngk")
    between, within = F.try_divide(g - s * s / n, k - 1), F.try_divide(q - g, n - k)
    return sums.select("column_name", F.try_divide(between, within).alias("score"))


def f_regression(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2) per feature, from one aggregate."""
    y = C.as_number(df, target)
    row = df.agg(F.count(y).alias("n"), *[F.corr(C.as_number(df, c), y).alias(f"r{i}") for i, c in enumerate(names)])
    rows = []
    for i, c in enumerate(names):
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        rows.append({"column_name": F.lit(c), "score": F.try_divide(r2 * (F.col("n") - 2), 1 - r2)})
    return C.inline_rows(row, rows)


def f_scores(df: DataFrame, names: list[str], target: str, class_limit: int = 20) -> DataFrame:
    """ANOVA F for a target with few values, correlation F otherwise."""
    few = df.select(target).distinct().limit(class_limit).count() < class_limit
    return (f_classif if few else f_regression)(df, names, target)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Score rows with the ``k`` best marked; a feature table, never data rows."""
    order = Window.orderBy(F.desc_nulls_last("score"), "column_name")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") <= k)


def mutual_information(df: DataFrame, names: list[str], target: str, bins: int = 10) -> DataFrame:
    """Binned mutual information between each feature and a class target.

    Features are cut at their exact quantiles, so equal values share a bin
    and no row has to be ranked.  One pass counts (feature, bin, class).
    """
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, names, probs)
    cells = []
    for c in names:
        x = C.as_number(df, c)
        bin_no = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges[c] if e is not None), F.lit(0))
        cells.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("column_name"), bin_no.alias("bin"))))
    long = df.where(F.col(target).isNotNull()).select(
        F.col(target).alias("y"), F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull()))
    )
    joint = long.groupBy("column_name", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # the joint table has one row per (feature, bin, class): windows over it are small
    def total(*parts: str) -> Column:
        return F.sum("n").over(Window.partitionBy("column_name", *parts))

    full = joint.select("column_name", "n", total("bin").alias("n_bin"), total("y").alias("n_class"), total().alias("n_all"))
    term = F.col("n") / F.col("n_all") * F.log(F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_class")))
    return full.groupBy("column_name").agg(F.sum(term).alias("score"))


# columns in a block of the matrix of moments, and partial sums that meet in one group
CORR_BLOCK, CORR_LANES = 64, 256


def _moment_blocks(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of one task for all pairs of columns, by block of columns.

    For a pair: the rows where both are there, the sums and the sums of squares of the
    first one over these rows, and the sums of products; each is one matrix product.
    """
    sums = np.zeros((4, len(shift), len(shift)))
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
        x = np.column_stack(columns) - shift
        there = ~np.isnan(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
    step = CORR_BLOCK
    cuts = [(i, j) for i in range(0, len(shift), step) for j in range(i, len(shift), step)]
    # the first column of a pair is that of the row, so both sides of the diagonal travel
    body = [np.stack([sums[:, i : i + step, j : j + step], sums[:, j : j + step, i : i + step].transpose(0, 2, 1)]).tobytes() for i, j in cuts]
    yield pa.record_batch([pa.array([i for i, _ in cuts], pa.int32()), pa.array([j for _, j in cuts], pa.int32()), pa.array(body, pa.binary())], names=["i", "j", "body"])


def _added(rows: pd.DataFrame) -> np.ndarray:
    total = np.zeros(len(rows["body"].iloc[0]) // 8)
    for body in rows["body"]:
        total += np.frombuffer(body)
    return total


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of each pair (earlier, later) over the rows that have both, in one scan.

    Each task sums a matrix of moments with one product a batch; the matrices are
    added block by block, in two rounds. Null where a column is constant. Columns
    are shifted by one of their values, so that large numbers do not cancel.
    """
    frame = df.select(*[C.as_number(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    head = frame.head(100)
    if not head:
        return df.sparkSession.createDataFrame([(a, b, None) for a, b in combinations(names, 2)], "earlier string, later string, corr double")
    shift = np.array([next((r[i] for r in head if r[i] is not None and math.isfinite(r[i])), 0.0) for i in range(len(names))])
    width, kind = len(names), "i int, j int, body binary"
    blocks = frame.mapInArrow(lambda batches: _moment_blocks(batches, shift), kind).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(CORR_LANES)))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "j": rows["j"].iloc[:1], "body": [_added(rows).tobytes()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        shape = (2, 4, min(CORR_BLOCK, width - i), min(CORR_BLOCK, width - j))
        (n, s, q, product), (_, t, r, _) = _added(rows).reshape(shape)
        with np.errstate(all="ignore"):
            first, second = q - s * s / n, r - t * t / n
            corr = (product - s * t / n) / np.sqrt(first * second)
            # what is left of a sum of squares that only rounding made
            corr[(first <= 1e-13 * q) | (second <= 1e-13 * r)] = np.nan
        a, b = np.nonzero(np.add.outer(np.arange(i, i + shape[2]), -np.arange(j, j + shape[3])) < 0)
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"earlier": text([names[i + x] for x in a]), "later": text([names[j + x] for x in b]), "corr": np.clip(corr[a, b], -1.0, 1.0)})

    some = blocks.groupBy("i", "j", "lane").applyInPandas(add, kind)
    pairs = some.groupBy("i", "j").applyInPandas(finish, "earlier string, later string, corr double")
    return pairs.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def select_correlation(df: DataFrame, names: list[str], threshold: float = 0.95, k: int | None = None) -> list[str]:
    """Columns left after dropping each one too close to any earlier column."""
    close = correlation_pairs(df, names).where(F.abs("corr") > threshold)
    dropped = {r["later"] for r in close.select("later").distinct().collect()}
    kept = [c for c in names if c not in dropped]
    return kept[:k] if k else kept


def project_features(df: DataFrame, selected: list[str], keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), *[c for c in selected if c not in (keep or [])])
