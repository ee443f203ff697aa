"""Input validation, sanitising and named expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import columns as C

# Literal fragments that raise a warning.
SQL_PATTERNS = ["'", '"', ";", "--", "/*", "*/", "xp_", "sp_"]
SCRIPT_PATTERNS = ["<script", "javascript:", "vbscript:", "onload=", "onerror="]
LARGE_VALUE = 1e10
LONG_STRING = 10_000


def _pattern_scan(df: DataFrame, patterns: list[str], fold_case: bool) -> DataFrame:
    names = C.string_columns(df)
    flags, rows = [], []
    for i, c in enumerate(names):
        text = F.lower(F.col(c)) if fold_case else F.col(c)
        for j, p in enumerate(patterns):
            flags.append(F.count_if(text.contains(p)).alias(f"h{i}_{j}"))
            rows.append({"column_name": F.lit(c), "pattern": F.lit(p), "n_rows": F.col(f"h{i}_{j}")})
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, pattern string, n_rows bigint")
    return C.inline_rows(df.agg(*flags), rows)


def scan_sql_patterns(df: DataFrame) -> DataFrame:
    """Rows per (column, pattern) that contain the literal fragment."""
    return _pattern_scan(df, SQL_PATTERNS, fold_case=False)


def scan_script_patterns(df: DataFrame) -> DataFrame:
    return _pattern_scan(df, SCRIPT_PATTERNS, fold_case=True)


def script_flag(text: Column) -> Column:
    """Row predicate: the text holds one of the script fragments."""
    low = F.lower(text)
    return reduce(Column.__or__, [low.contains(p) for p in SCRIPT_PATTERNS])


def check_large_values(df: DataFrame, limit: float = LARGE_VALUE) -> DataFrame:
    names = C.numeric_columns(df)
    row = df.agg(*[F.max(F.abs(C.as_number(df, c))).alias(f"x{i}") for i, c in enumerate(names)])
    return C.inline_rows(
        row,
        [{"column_name": F.lit(c), "max_abs": F.col(f"x{i}"), "flagged": F.coalesce(F.col(f"x{i}") > limit, F.lit(False))} for i, c in enumerate(names)],
    )


def check_long_strings(df: DataFrame, limit: int = LONG_STRING) -> DataFrame:
    names = C.string_columns(df)
    row = df.agg(*[F.max(F.char_length(c)).cast("bigint").alias(f"x{i}") for i, c in enumerate(names)])
    return C.inline_rows(
        row,
        [{"column_name": F.lit(c), "max_length": F.col(f"x{i}"), "flagged": F.coalesce(F.col(f"x{i}") > limit, F.lit(False))} for i, c in enumerate(names)],
    )


def schema_checks(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Missing and unexpected columns, and names that hint at leakage."""
    rows = []
    if expected is not None:
        rows += [("expected_columns", c, "error", "missing") for c in expected if c not in df.columns]
        rows += [("expected_columns", c, "warning", "unexpected") for c in df.columns if c not in expected]
    for c in df.columns:
        low = c.lower()
        if "id" in low or "key" in low:
            rows.append(("leakage", c, "warning", "id"))
        if "time" in low or "date" in low:
            rows.append(("leakage", c, "warning", "timestamp"))
    return df.sparkSession.createDataFrame(rows, "check string, column_name string, severity string, detail string")


def validate_input(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """All findings of all checks, one row each."""

    def rows(frame: DataFrame, check: str, detail: Column) -> DataFrame:
        return frame.select(F.lit(check).alias("check"), "column_name", F.lit("warning").alias("severity"), detail.alias("detail"))

    parts = [schema_checks(df, expected)]
    if C.string_columns(df):
        # one aggregate over the table for all text checks
        names, flags, found = C.string_columns(df), [], []
        for i, c in enumerate(names):
            low = F.lower(F.col(c))
            for check, patterns, text in (("sql_pattern", SQL_PATTERNS, F.col(c)), ("script_pattern", SCRIPT_PATTERNS, low)):
                for j, p in enumerate(patterns):
                    name = f"{check}{i}_{j}"
                    flags.append(F.bool_or(text.contains(p)).alias(name))
                    found.append({"check": F.lit(check), "column_name": F.lit(c), "hit": F.col(name), "detail": F.lit(p)})
            flags.append(F.max(F.char_length(c)).alias(f"len{i}"))
            found.append(
                {"check": F.lit("long_string"), "column_name": F.lit(c), "hit": F.col(f"len{i}") > LONG_STRING, "detail": F.col(f"len{i}").cast("string")}
            )
        hits = C.inline_rows(df.agg(*flags), found).where("hit")
        parts.append(hits.select("check", "column_name", F.lit("warning").alias("severity"), "detail"))
    if C.numeric_columns(df):
        parts.append(rows(check_large_values(df).where("flagged"), "large_value", F.lit("absolute value above limit")))
    return reduce(DataFrame.unionByName, parts)


def sanitize_html(df: DataFrame) -> DataFrame:
    """Angle brackets of every string column as entities; nulls stay null."""
    return df.withColumns({c: escape_markup(F.col(c)) for c in C.string_columns(df)})


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def hash_rows(df: DataFrame, column: str, out: str = "sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(column), 256))


def hmac_sign(df: DataFrame, column: str, secret: bytes, out: str = "signature") -> DataFrame:
    return df.withColumn(out, C.hmac_sha256(F.col(column), secret))


def hmac_verify(df: DataFrame, column: str, signature: str, secret: bytes, out: str = "valid") -> DataFrame:
    return df.withColumn(out, F.coalesce(C.hmac_sha256(F.col(column), secret) == F.col(signature), F.lit(False)))


def expectation_suite(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each named row predicate with its failures; ``(overall)`` joins them.

    A predicate that is NULL for a row counts as failed.
    """
    row = df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(f"f{i}") for i, p in enumerate(checks.values())])
    rows = [{"check": F.lit(n), "failures": F.col(f"f{i}"), "healthy": F.col(f"f{i}") == 0} for i, n in enumerate(checks)]
    total = reduce(Column.__add__, [F.col(f"f{i}") for i in range(len(checks))])
    rows.append({"check": F.lit("(overall)"), "failures": total, "healthy": total == 0})
    return C.inline_rows(row, rows)


def coerce_fill(df: DataFrame, names: list[str], fill: float = 0.0) -> DataFrame:
    """Columns as double; what does not parse, and NaN, becomes ``fill``."""

    def clean(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return F.coalesce(F.when(~F.isnan(number), number), F.lit(float(fill)))

    return df.withColumns({c: clean(c) for c in names})
