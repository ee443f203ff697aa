"""Exact quantiles that stay exact, and distributed, on very large columns.

Spark's ``percentile`` keeps every distinct value of a column in one task.  It
is used only below a row threshold.  Above it each wanted order statistic is
closed in on: an approximate percentile proposes two values around it, one
aggregate counts the rows on either side, and the open interval between them
shrinks by orders of magnitude per pass.  Only map-side aggregates run; no
column is ever sorted or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from loomframe.functions.columns import as_number, wide_aggregate

SMALL_COLUMN = 500_000
_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small: int = SMALL_COLUMN
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, missing values skipped."""
    if not columns:
        return {}
    values = df.select(*[as_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    ids = [f"v{i}" for i in range(len(columns))]
    counts = wide_aggregate(values, [F.count(v).alias(v) for v in ids])
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}

    near = [v for v in ids if 0 < counts[v] <= small]
    if near:
        literals = F.array(*[F.lit(float(p)) for p in probs])
        # a task holds the distinct values of all columns of a chunk
        chunk = max(1, min(50, 4 * small // max(counts[v] for v in near)))
        found = wide_aggregate(values, [F.percentile(v, literals).alias(v) for v in near], chunk=chunk)
        for v in near:
            result[columns[int(v[1:])]] = list(found[v])

    far = {v: counts[v] for v in ids if counts[v] > small}
    if far:
        wanted = set()
        for v, n in far.items():
            for p in probs:
                place = p * (n - 1)
                wanted.add((v, math.floor(place)))
                wanted.add((v, math.ceil(place)))
        stats = order_statistics(values, wanted, far, small)
        for v, n in far.items():
            row = []
            for p in probs:
                place = p * (n - 1)
                low, high = math.floor(place), math.ceil(place)
                row.append(_between(stats[(v, low)], stats[(v, high)], place - low))
            result[columns[int(v[1:])]] = row
    return result


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation that also holds for infinite ends."""
    if a == b or share == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        return a * (1 - share) + b * share
    return a + share * (b - a)


def order_statistics(values: DataFrame, wanted: set, counts: dict[str, int], small: int) -> dict:
    """Value at each (column, zero-based rank), by interval narrowing.

    Ranks of a column that lie in the same open interval share its sketch and
    its final sort, so the first pass costs one sketch per column.
    """
    found: dict = {}
    # interval (column, low, high) without its ends, None where it has none, so that
    # infinite values lie inside -> (rows at or below low, rows inside, wanted ranks)
    spans: dict = {}
    for name, rank in wanted:
        spans.setdefault((name, None, None), (0, counts[name], []))[2].append(rank)

    def inside(span):
        name, low, high = span
        v = F.col(name)
        above = F.lit(True) if low is None else v > F.lit(low)
        below = F.lit(True) if high is None else v < F.lit(high)
        return F.when(above & below, v)

    while spans:
        ready = [s for s, (_, size, _) in spans.items() if size <= small]
        if ready:
            picks = []
            for i, span in enumerate(ready):
                below, _, ranks = spans[span]
                ordered = F.sort_array(F.collect_list(inside(span)))
                picks.append(F.array(*[F.get(ordered, F.lit(r - below)) for r in ranks]).alias(f"p{i}"))
            row = wide_aggregate(values, picks, chunk=8)
            for i, span in enumerate(ready):
                found.update({(span[0], r): x for r, x in zip(spans.pop(span)[2], row[f"p{i}"])})
        if not spans:
            break

        pending = list(spans)
        exprs, step = [], 2.0 / _ACCURACY
        for i, span in enumerate(pending):
            below, size, ranks = spans[span]
            shares = [(r - below) / max(size - 1, 1) for r in ranks]
            around = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-step, step)]
            exprs.append(F.percentile_approx(inside(span), around, _ACCURACY).alias(f"b{i}"))
        bounds = wide_aggregate(values, exprs, chunk=50)

        edges = sorted({(span[0], e) for i, span in enumerate(pending) for e in bounds[f"b{i}"]})
        exprs = []
        for j, (name, edge) in enumerate(edges):
            v = F.col(name)
            exprs += [F.count_if(v < F.lit(edge)).alias(f"lt{j}"), F.count_if(v <= F.lit(edge)).alias(f"le{j}")]
        row = wide_aggregate(values, exprs)
        tally = {edge: (row[f"lt{j}"], row[f"le{j}"]) for j, edge in enumerate(edges)}

        narrowed: dict = {}
        for i, span in enumerate(pending):
            name, low, high = span
            below, size, ranks = spans[span]
            for r, a, b in zip(ranks, bounds[f"b{i}"][::2], bounds[f"b{i}"][1::2]):
                (a_lt, a_le), (b_lt, b_le) = tally[(name, a)], tally[(name, b)]
                if a_lt <= r < a_le:
                    found[(name, r)] = a
                    continue
                if b_lt <= r < b_le:
                    found[(name, r)] = b
                    continue
                if r < a_lt:
                    part, state = (name, low, a), (below, a_lt - below)
                elif r >= b_le:
                    part, state = (name, b, high), (b_le, below + size - b_le)
                else:
                    part, state = (name, a, b), (a_le, b_lt - a_le)
                narrowed.setdefault(part, (*state, []))[2].append(r)
        spans = narrowed
    return found
