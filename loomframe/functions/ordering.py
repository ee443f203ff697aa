"""Global ranks and running sums without a single-partition window.

A window without PARTITION BY pulls every row into one task.  Here rows are
cut into buckets that respect the order; each bucket is ranked on its own and
shifted by the sizes of the buckets before it.  The table of bucket sizes is
bounded by the number of buckets.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomframe.session import materialize

ROWS_PER_BUCKET = 250_000
# cut points of a score that the driver holds; a range then holds equal scores counted once
MAX_SCORE_RANGES = 65_536


def seeded_digest(seed: str | int, key: str | Column) -> Column:
    """MD5 text that orders rows pseudo-randomly but reproducibly."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def seeded_rank(df: DataFrame, seed, key: str, by: list[str] | None = None, out: str = "rn", width: int | None = None) -> DataFrame:
    """1-based rank of each row in seeded order, per group ``by``.

    The first ``width`` hex digits of the digest are the bucket: uniform for
    any data, so a group holding a third of the table spreads over
    16**width tasks.  By default the digits follow the number of rows.
    """
    by = list(by or [])
    if width is None:
        width = max(1, math.ceil(math.log(max(df.count() / ROWS_PER_BUCKET, 1), 16)) + 1)
    digest, bucket, before = f"__d_{out}", f"__b_{out}", f"__o_{out}"
    keyed = df.withColumn(digest, seeded_digest(seed, key)).withColumn(bucket, F.substring(digest, 1, width))
    sizes = keyed.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"__g_{i}") for i, c in enumerate(by)],
        F.col(bucket).alias("__gb"),
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias(before),
    )
    inner = Window.partitionBy(*by, bucket).orderBy(digest, key)
    ranked = keyed.withColumn("__in", F.row_number().over(inner).cast("bigint"))
    same = F.col(bucket) == F.col("__gb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{i}"))
    joined = ranked.join(offsets, same)
    return joined.withColumn(out, F.col(before) + F.col("__in")).select(*df.columns, out)


def _bucketize(df: DataFrame, source: Column, edges: list[float], out: str) -> DataFrame:
    splits = [-math.inf, *sorted(set(edges)), math.inf]
    temp = f"__x_{out}"
    stage = Bucketizer(splits=splits, inputCol=temp, outputCol=out, handleInvalid="keep")
    return stage.transform(df.withColumn(temp, source)).drop(temp)


# moduli of the two mixing steps; products of what is below them and a key fit into 64 bits
MIX_PRIMES = (2_147_483_647, 2_147_483_629)
MIX_ROUNDS = 4


def permutation_keys(seed: str | int) -> list[tuple[int, int, int]]:
    """Three numbers for each round of ``permuted``, drawn from the seed."""
    draw = lambda i, j: 1 + int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:7], 16)
    return [(draw(i, 0), draw(i, 1), draw(i, 2)) for i in range(MIX_ROUNDS)]


def permutation_sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square that holds ``n`` places."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(place: Column, n: int, keys: list[tuple]) -> Column:
    """A keyed bijection of 0..n-1, computed for each place on its own; keys are numbers or columns.

    A place is written as row and column of a near-square; rounds add a mix of the one
    to the other, which can be undone whatever the mix. Results beyond ``n`` (less than
    one in a row's length) go through it again until they are below.
    """
    a, b = permutation_sides(n)

    def once(x: Column) -> Column:
        side = [F.floor(x / F.lit(b)).cast("long"), (x % F.lit(b)).cast("long")]
        for i, (k, add, last) in enumerate(keys):
            own, other, width = i % 2, 1 - i % 2, b if i % 2 else a
            u = (side[other] * k + add) % F.lit(MIX_PRIMES[0])
            side[own] = (side[own] + (u * last + add) % F.lit(MIX_PRIMES[1])) % F.lit(width)
        return side[0] * b + side[1]

    first = once(place.cast("long"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(F.when(again < n, again).otherwise(F.raise_error(F.lit("no place found")).cast("long")))


def _shares(count: int) -> list[float]:
    return [i / count for i in range(1, count)]


def _tie_breaker(df: DataFrame) -> Column:
    """A hash of the whole row, so that a value shared by many rows can be cut."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def global_row_number(
    df: DataFrame, order: list[tuple[str, str]], out: str = "rn", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """``row_number() over (order by ...)`` for columns of any orderable types.

    ``order`` holds (column, "asc"|"desc") pairs; missing values come last.  Rows
    are cut into ranges of the whole order, ties by a hash of the row, so a value
    that fills many ranges is spread over them.  Each range is written with its
    number, ranked on its own and shifted by the sizes of the ranges before it.
    """
    keys = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]
    marked = df.withColumn("__tie", _tie_breaker(df))
    keys.append(F.col("__tie").asc())
    buckets = math.ceil(df.count() / rows_per_bucket)
    if buckets <= 1:
        return marked.withColumn(out, F.row_number().over(Window.orderBy(*keys)).cast("bigint")).select(*df.columns, out)
    cut = materialize(marked.repartitionByRange(buckets, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range
    running = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__off"))
    ranked = cut.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)).cast("bigint"))
    return ranked.join(offsets, "__part").withColumn(out, F.col("__off") + F.col("__in")).select(*df.columns, out)


def order_index(df: DataFrame, column: str, out: str = "code", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Distinct values of a string column with their 0-based sorted position."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return global_row_number(values, [("value", "asc")], out, rows_per_bucket).withColumn(out, F.col(out) - 1)


def score_edges(df: DataFrame, score: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Cut points of a score column for ordered running sums."""
    ranges = min(MAX_SCORE_RANGES, math.ceil(df.count() / rows_per_bucket))
    if ranges <= 1:
        return []
    found = df.agg(F.percentile_approx(F.col(score).cast("double"), _shares(ranges), max(10_000, 4 * ranges)).alias("e")).first()
    return sorted(set(found["e"] or []))


def cut_by_edges(df: DataFrame, score: str, edges: list[float], out: str = "__cut") -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    return _bucketize(df, F.col(score).cast("double"), edges, out)
