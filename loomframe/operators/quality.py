"""Profiling: types, missing values, duplicates, footprints, fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomframe.functions import columns as C
from loomframe.functions.text import word_count

# The date shapes that mark a string column as datetime.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{4}/\d{2}/\d{2}",
]
# Values looked at per column, the most classes of a numeric target,
# and the share of different values below which text repeats.
SAMPLE_VALUES = 10
TASK_CLASSES = 20
REPEATED_SHARE = 0.1


# rows in key order that most columns find their first values in
HEAD_ROWS = 50
# size of the distinct-count sketches, their relative standard deviation, and how many of these count as near
SKETCH_BITS, SKETCH_ERROR, SKETCH_SPREAD = 12, 0.017, 6
# columns with at most about so many values are counted exactly within the row aggregate
SET_VALUES = 4_096
# columns counted side by side that way: bounds the sets that one task holds
SET_COLUMNS = 50


def first_values(df: DataFrame, key: str, names: list[str], count: int = SAMPLE_VALUES) -> DataFrame:
    """First ``count`` non-missing values per column in key order, long form.

    The first rows in key order hold them for all columns but those that are mostly
    missing there; the cells of these few are ranked by column in one more pass. Each
    task keeps ``count`` cells a column, nothing is sorted as a whole.
    """
    spark = df.sparkSession
    cells = [F.when(~C.is_missing(df, c), F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(names)]
    if not names:
        return spark.createDataFrame([], "column_name string, value string")
    head = df.orderBy(key).limit(max(HEAD_ROWS, count)).select(*cells).collect()
    found = {c: [r[i] for r in head if r[i] is not None][:count] for i, c in enumerate(names)}
    short = [c for c in names if len(found[c]) < count] if len(head) == max(HEAD_ROWS, count) else []
    rows = [(c, v) for c in names if c not in short for v in found[c]]
    known = spark.createDataFrame(rows, "column_name string, value string")
    if not short:
        return known
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), cells[names.index(c)].alias("value")) for c in short])
    long = df.select(F.col(key).alias("at"), F.explode(F.filter(pairs, lambda s: s["value"].isNotNull())).alias("cell")).select("at", "cell.*")
    nth = F.row_number().over(Window.partitionBy("column_name").orderBy("at"))
    return known.unionByName(long.withColumn("nth", nth).where(F.col("nth") <= count).select("column_name", "value"))


def _sketches(df: DataFrame, names: list[str], value: Callable[[DataFrame, str], Column]) -> list[Column]:
    hashed = [F.when(value(df, c).isNotNull(), F.xxhash64(value(df, c))) for c in names]
    return [F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(h, SKETCH_BITS)), F.lit(0)).alias(f"__d{i}") for i, h in enumerate(hashed)]


def distinct_counts(df: DataFrame, names: list[str], value: Callable[[DataFrame, str], Column] = C.distinct_key, about: dict[str, int] | None = None) -> dict[str, int]:
    """Exact number of different values per column, without a copy of the rows for each column.

    Sketches of all columns take one pass, if ``about`` does not hold them. Columns with few
    values are then counted by sets inside one more pass; each other column by a scan of
    that column alone, all in one job.
    """
    if about is None:
        found = C.wide_aggregate(df, _sketches(df, names, value))
        about = {c: found[f"__d{i}"] for i, c in enumerate(names)}
    few = [c for c in names if about[c] <= SET_VALUES]
    sets = [F.size(F.collect_set(value(df, c))).cast("long").alias(c) for c in few]
    exact = C.wide_aggregate(df, sets, SET_COLUMNS)
    many = [c for c in names if about[c] > SET_VALUES]
    if many:
        each = [df.agg(F.count_distinct(value(df, c)).alias("n")).select(F.lit(c).alias("c"), "n") for c in many]
        exact |= {r["c"]: r["n"] for r in reduce(DataFrame.unionByName, each).collect()}
    return exact


def _near(count: int, border: float) -> bool:
    """Whether a sketch leaves open on which side of the border the true count lies."""
    return abs(count - border) <= SKETCH_SPREAD * SKETCH_ERROR * max(count, border) + 1


def column_facts(df: DataFrame) -> dict:
    """Rows, missing cells of every column and about the distinct values of every text column, in one pass."""
    strings = C.string_columns(df)
    exprs = [F.count(F.lit(1)).alias("__rows"), *[F.count_if(C.is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(df.columns)]]
    found = C.wide_aggregate(df, [*exprs, *_sketches(df, strings, C.distinct_key)])
    return {
        "rows": found["__rows"],
        "missing": {c: found[f"__m{i}"] for i, c in enumerate(df.columns)},
        "distinct": {c: found[f"__d{i}"] for i, c in enumerate(strings)},
    }


def type_map(df: DataFrame, key: str, facts: dict | None = None) -> dict[str, str]:
    """Column name to numeric / categorical / datetime / text."""
    found: dict[str, str] = {}
    strings = C.string_columns(df)
    for field in df.schema.fields:
        if isinstance(field.dataType, C.TIME_TYPES):
            found[field.name] = "datetime"
        elif isinstance(field.dataType, C.NUMERIC_TYPES + (T.BooleanType,)):
            found[field.name] = "numeric"
        elif not isinstance(field.dataType, T.StringType):
            found[field.name] = "categorical"
    if strings:
        dated = reduce(Column.__or__, [F.col("value").rlike(p) for p in DATE_PATTERNS])
        sampled = (
            first_values(df, key, strings)
            .groupBy("column_name")
            .agg(F.avg(dated.cast("int")).alias("dated"), F.avg(F.char_length("value")).alias("length"))
        )
        seen = {r["column_name"]: r for r in sampled.collect()}
        facts = facts or column_facts(df)
        border = facts["rows"] * REPEATED_SHARE
        counts = facts["distinct"] | distinct_counts(df, [c for c in strings if _near(facts["distinct"][c], border)], about=facts["distinct"])
        for name in strings:
            sample = seen.get(name)
            if sample and sample["dated"] > 0.5:
                found[name] = "datetime"
            elif facts["rows"] and counts[name] / facts["rows"] < REPEATED_SHARE:
                found[name] = "categorical"
            elif sample and sample["length"] > 20:
                found[name] = "text"
            else:
                found[name] = "categorical"
    return {name: found[name] for name in df.columns}


def detect_types(df: DataFrame, key: str) -> DataFrame:
    rows = list(type_map(df, key).items())
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")


def type_counts(df: DataFrame, key: str) -> DataFrame:
    return detect_types(df, key).groupBy("column_type").agg(F.count(F.lit(1)).alias("n_columns"))


def _missing_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per column: rows and missing cells, from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(C.is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(names)])
    rows = [
        {"position": F.lit(i), "column_name": F.lit(c), "n_rows": F.col("__rows"), "missing": F.col(f"__m{i}")}
        for i, c in enumerate(names)
    ]
    return C.inline_rows(counts, rows)


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells per column plus the ``(all)`` row for the whole table."""
    long = _missing_counts(df, df.columns)
    share = C.safe_divide(F.sum("missing"), F.sum("n_rows"))
    total = long.agg(F.lit("(all)").alias("column_name"), F.sum("missing").alias("missing"), share.alias("ratio"))
    each = long.select("column_name", "missing", C.safe_divide(F.col("missing"), F.col("n_rows")).alias("ratio"))
    return each.unionByName(total)


def schema_report(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return _missing_counts(df, df.columns).select(
        "column_name",
        F.element_at(kinds, F.col("column_name")).alias("data_type"),
        (F.col("n_rows") - F.col("missing")).alias("non_null"),
        "missing",
        F.round(C.safe_divide(F.col("missing"), F.col("n_rows")) * 100, 2).alias("missing_pct"),
    )


def missing_ranking(df: DataFrame) -> DataFrame:
    long = _missing_counts(df, df.columns).where("missing > 0")
    return long.select("column_name", "missing").orderBy(F.desc("missing"), "column_name")


def task_types(df: DataFrame, names: list[str] | None = None, threshold: float = 0.05) -> DataFrame:
    """classification / regression per column, with the exact distinct counts."""
    names = names or df.columns
    rows, exact = df.count(), distinct_counts(df, names)
    found = []
    for c in names:
        kind, unique = df.schema[c].dataType, exact[c]
        if isinstance(kind, C.INTEGER_TYPES):
            classes = unique <= TASK_CLASSES
        elif isinstance(kind, C.NUMERIC_TYPES + (T.BooleanType,)):
            classes = unique <= TASK_CLASSES and (unique / rows if rows else 0.0) < threshold
        else:
            classes = True
        found.append((c, unique, "classification" if classes else "regression"))
    return df.sparkSession.createDataFrame(found, "column_name string, n_unique bigint, task_type string")


def task_type_of(df: DataFrame, target: str, threshold: float = 0.05) -> str:
    return task_types(df, [target], threshold).first()["task_type"]


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    ratio = C.safe_divide(F.min("n"), F.max("n"))
    return class_counts(df, target).agg(F.count(F.lit(1)).alias("n_classes"), ratio.alias("class_balance"))


def recommended_metric(df: DataFrame, target: str, imbalance: float = 0.3) -> DataFrame:
    """Metric a search should maximise for this target."""
    task = task_type_of(df, target)
    if task == "regression":
        return df.sparkSession.createDataFrame([(target, task, None, "r2")], "target string, task_type string, class_balance double, metric string")
    metric = F.when(F.col("class_balance") < imbalance, "balanced_accuracy").otherwise("f1")
    return class_balance(df, target).select(
        F.lit(target).alias("target"), F.lit(task).alias("task_type"), "class_balance", metric.alias("metric")
    )


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Rows are compared by SHA-256 so that the shuffle moves 32 bytes per
    distinct row and map-side counts absorb hot copies.
    """
    names = names or df.columns
    cells = F.struct(*[C.present(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    digest = F.unhex(F.sha2(F.to_json(cells, {"ignoreNullFields": "false"}), 256))
    groups = df.select(digest.alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    extra, total = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.sum("n")
    return groups.agg(extra.alias("duplicate_rows"), C.safe_divide(extra, total).alias("duplicate_ratio"))


def cardinalities(df: DataFrame, names: list[str], approximate: bool = False, about: dict[str, int] | None = None) -> DataFrame:
    """Different values per column; ``approximate`` leaves it at the sketches."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(names)])
        return C.inline_rows(row, [{"column_name": F.lit(c), "n_unique": F.col(f"u{i}")} for i, c in enumerate(names)])
    exact = distinct_counts(df, names, about=about)
    return df.sparkSession.createDataFrame([(c, exact[c]) for c in names], "column_name string, n_unique bigint")


def table_footprint(df: DataFrame) -> DataFrame:
    """Bytes of content per column; sizes do not depend on the storage format."""
    row = df.agg(*[F.sum(F.octet_length(F.col(c).cast("string"))).alias(f"b{i}") for i, c in enumerate(df.columns)])
    return C.inline_rows(
        row, [{"column_name": F.lit(c), "n_bytes": F.coalesce(F.col(f"b{i}"), F.lit(0))} for i, c in enumerate(df.columns)]
    )


def dataset_fingerprint(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Order-insensitive hash: the sum of 60-bit row hashes."""
    text = C.row_text(df, names or df.columns)
    total = F.sum(C.hash60(text).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def dataset_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """One-row profile of a table; text means an average length above 20."""
    strings = C.string_columns(df)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    exprs += [F.count_if(C.is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(df.columns)]
    # missing cells are left out of the average length
    exprs += [F.avg(F.char_length(c)).alias(f"__l{i}") for i, c in enumerate(strings)]
    found = C.wide_aggregate(df, exprs)
    n_rows, n_cols = found["__rows"], len(df.columns)
    missing = sum(found[f"__m{i}"] for i in range(n_cols))
    n_text = sum(1 for i in range(len(strings)) if (found[f"__l{i}"] or 0) > 20)
    task = balance = None
    if target in df.columns:
        task = task_type_of(df, target)
        if task == "classification":
            balance = class_balance(df, target).first()["class_balance"]
    text = C.row_text(df, df.columns)
    total = F.coalesce(F.sum(C.hash60(text).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_cols).cast("bigint").alias("n_cols"),
        F.lit(len(C.numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(strings) - n_text).cast("bigint").alias("n_categorical"),
        F.lit(len(C.time_columns(df))).cast("bigint").alias("n_datetime"),
        F.lit(n_text).cast("bigint").alias("n_text"),
        F.lit(missing / (n_rows * n_cols) if n_rows else 0.0).alias("missing_ratio"),
        C.literal(balance).alias("class_balance"),
        F.lit(task).cast("string").alias("task_type"),
        F.lit(target).cast("string").alias("target"),
        F.array(*[F.lit(c) for c in df.columns if c != target]).alias("features"),
        total.cast("string").alias("data_hash"),
    )


def text_columns(df: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """String columns where enough of the first values have several words."""
    names = C.string_columns(df)
    several = F.avg((word_count(F.col("value")) > 1).cast("int"))
    return (
        first_values(df, key, names)
        .groupBy("column_name")
        .agg(several.alias("multi_word_share"))
        .withColumn("is_text", F.col("multi_word_share") > share)
    )


def text_column_names(df: DataFrame, key: str) -> list[str]:
    found = {r["column_name"] for r in text_columns(df, key).where("is_text").collect()}
    return [c for c in df.columns if c in found]


def target_distribution(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """Long (name, value) rows that describe the target."""
    task = task or task_type_of(df, target)
    y = C.as_number(df, target)
    if task == "regression":
        row = df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"))
        return C.inline_rows(row, [{"name": F.lit(c), "value": F.col(c)} for c in row.columns])
    counts = class_counts(df, target)
    if counts.limit(6).count() <= 5:
        return counts.select(F.concat(F.lit("class "), F.col("class").cast("string")).alias("name"), F.col("n").cast("double").alias("value"))
    row = counts.agg(F.count(F.lit(1)).cast("double").alias("classes"), F.max("n").cast("double").alias("top_count"), (F.max("n") / F.sum("n")).alias("top_share"))
    return C.inline_rows(row, [{"name": F.lit(c), "value": F.col(c)} for c in row.columns])


def feature_statistics(df: DataFrame) -> DataFrame:
    numeric = C.numeric_columns(df)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    exprs += [F.avg(C.as_number(df, c)).alias(f"__a{i}") for i, c in enumerate(numeric)]
    exprs += [F.stddev_samp(C.as_number(df, c)).alias(f"__s{i}") for i, c in enumerate(numeric)]
    exprs += [F.count_if(C.is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*exprs)

    def mean_of(prefix: str) -> Column:
        values = F.filter(F.array(*[F.col(f"{prefix}{i}") for i in range(len(numeric))]), lambda x: x.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        return F.try_divide(total, F.size(values))

    missing = reduce(Column.__add__, [F.col(f"__m{i}") for i in range(len(df.columns))])
    return row.select(
        F.col("__rows").alias("n_rows"),
        (mean_of("__a") if numeric else C.literal(None)).alias("mean_of_means"),
        (mean_of("__s") if numeric else C.literal(None)).alias("mean_of_stds"),
        F.lit(len(numeric)).cast("bigint").alias("n_numeric"),
        F.lit(len(C.string_columns(df))).cast("bigint").alias("n_categorical"),
        F.lit(len(C.time_columns(df))).cast("bigint").alias("n_datetime"),
        (C.safe_divide(missing, F.col("__rows")) / len(df.columns) * 100).alias("missing_pct"),
    )


def quality_report(df: DataFrame, key: str) -> DataFrame:
    """Types, missing values, outliers, duplicates and sizes as long rows."""
    from loomframe.operators.outliers import iqr_counts

    facts = column_facts(df)
    types = type_map(df, key, facts)
    numeric = [c for c in C.numeric_columns(df)]
    categorical = [c for c, t in types.items() if t == "categorical"]
    spark = df.sparkSession

    def rows(frame: DataFrame, section: str, column: Column, name: Column, value: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"), column.alias("column_name"), name.alias("name"), value.cast("double").alias("value")
        )

    whole = F.lit("(all)")
    typed = spark.createDataFrame(list(types.items()), "column_name string, column_type string")
    parts = [
        rows(typed, "type", F.col("column_name"), F.col("column_type"), F.lit(1)),
        rows(spark.createDataFrame(list(facts["missing"].items()), "column_name string, missing long"), "missing", F.col("column_name"), F.lit("count"), F.col("missing")),
        rows(spark.range(1), "shape", whole, F.lit("rows"), F.lit(facts["rows"])),
        rows(spark.range(1), "shape", whole, F.lit("columns"), F.lit(len(df.columns))),
        rows(duplicate_rows(df), "duplicates", whole, F.lit("rows"), F.col("duplicate_rows")),
    ]
    for kind in ("numeric", "categorical", "datetime", "text"):
        parts.append(rows(spark.range(1), "type_count", whole, F.lit(kind), F.lit(sum(t == kind for t in types.values()))))
    if numeric:
        parts.append(rows(iqr_counts(df, numeric), "outliers", F.col("column_name"), F.lit("count"), F.col("n_outliers")))
    if categorical:
        parts.append(rows(cardinalities(df, categorical, about=facts["distinct"] if all(c in facts["distinct"] for c in categorical) else None), "cardinality", F.col("column_name"), F.lit("distinct"), F.col("n_unique")))
    return reduce(DataFrame.unionByName, parts)
