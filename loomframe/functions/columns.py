"""Column classes and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *NUMERIC_TYPES)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def time_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *TIME_TYPES)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL and, for floating columns, NaN are one notion of missing."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that aggregates skip it."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        return F.when(~F.isnan(column), column)
    return column


def distinct_key(df: DataFrame, name: str) -> Column:
    """What a distinct count compares: 16-byte digests instead of long text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.unhex(F.md5(F.col(f"`{name}`").cast("binary")))
    return present(df, name)


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column as double, NaN read as NULL."""
    return present(df, name).cast("double")


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(default)))


def literal(value) -> Column:
    """A double literal; ``None`` becomes a typed NULL."""
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def inline_rows(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn each input row into one output row per entry of ``rows``."""
    structs = [F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def wide_aggregate(df: DataFrame, exprs: list[Column], chunk: int = 200) -> dict:
    """Run many global aggregates, at most ``chunk`` per job, into one dict."""
    out: dict = {}
    for start in range(0, len(exprs), chunk):
        out.update(df.agg(*exprs[start : start + chunk]).first().asDict())
    return out


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest per RFC 2104, as two nested built-in hashes."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def row_text(df: DataFrame, names: list[str]) -> Column:
    """A row as text: no two different rows share one, whatever separators their cells hold.

    Every cell starts with its length; a missing cell (NULL or NaN) is a lone
    dash.  Doubles are written with fifteen significant digits.
    """
    parts = []
    for name in names:
        kind = df.schema[name].dataType
        column = F.col(f"`{name}`")
        if isinstance(kind, FLOAT_TYPES):
            number = column.cast("double") + F.lit(0.0)
            text = F.when(number.isNotNull() & ~F.isnan(number), F.when(number == float("inf"), "inf").when(number == float("-inf"), "-inf").otherwise(F.format_string("%.14e", number)))
        elif isinstance(kind, TIME_TYPES):
            text = F.unix_micros(column.cast("timestamp")).cast("string")
        else:
            text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def hash60(text: Column) -> Column:
    """First 60 bits of the MD5 digest as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def hash_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket number from the first 32 bits of MD5."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
