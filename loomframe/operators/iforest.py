"""Isolation forest: trees from hashed samples, scores as a vectorised function.

Each tree sees at most 256 rows, picked by a hash of (seed, tree, key), so the
forest is the same however the table is partitioned.  Growing is one small
group per tree; scoring is one pass over the table with the forest in the
closure (trees x 511 nodes at most).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.quantiles import exact_quantiles
from loomframe.session import materialize, spread

SAMPLE_ROWS = 256
_FLOATS = "tree int, node int, feature int, threshold double, left int, right int, path double"


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    usual = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, usual, np.where(n == 2, 1.0, 0.0))


def grow_forest(df: DataFrame, key: str, names: list[str], trees: int = 100, seed: int = 42) -> pd.DataFrame:
    """Node table of the whole forest."""
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.coalesce(C.as_number(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)])
    total = rows.count()
    scale = 1 << 40

    def draw(*parts) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(scale))

    # every row is drawn for every tree inside the row; only what a tree may take is spread
    chance = min(1.0, 2.0 * SAMPLE_ROWS / max(total, 1))
    limit = int(scale * chance)
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t, F.col("key")).alias("draw")))
    sampled = rows.withColumn("taken", F.filter(draws, lambda d: d["draw"] <= limit))
    sampled = sampled.select("*", F.inline("taken")).drop("taken")
    width = len(names)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values(["draw", "key"]).head(SAMPLE_ROWS)
        values = data[[f"x{i}" for i in range(width)]].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(values), 2)))
        nodes: list[list] = []
        todo = [(values, 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][4 + side] = node
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else np.array([], dtype=int)
            if depth >= limit or not len(spread):
                nodes.append([tree, node, -1, 0.0, -1, -1, depth + float(_average_path(len(part)))])
                continue
            feature = int(rng.choice(spread))
            low, high = part[:, feature].min(), part[:, feature].max()
            threshold = float(rng.uniform(low, high))
            nodes.append([tree, node, feature, threshold, -1, -1, 0.0])
            goes_left = part[:, feature] <= threshold
            todo.append((part[~goes_left], depth + 1, node, 1))
            todo.append((part[goes_left], depth + 1, node, 0))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _FLOATS.split(", ")])

    return sampled.groupBy("tree").applyInPandas(grow, _FLOATS).toPandas()


def score_forest(df: DataFrame, key: str, names: list[str], forest: pd.DataFrame, sample: int) -> DataFrame:
    """(key, score): 2 ** (-mean depth / expected depth); near 1 is isolated."""
    trees = [t.sort_values("node") for _, t in forest.groupby("tree")]
    packed = [tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")) for t in trees]
    expected = max(float(_average_path(min(sample, SAMPLE_ROWS))), 1e-9)
    width = len(names)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[[f"x{i}" for i in range(width)]].to_numpy(dtype=np.float64)
            depth = np.zeros(len(x))
            for feature, threshold, left, right, path in packed:
                at = np.zeros(len(x), dtype=np.int64)
                active = np.flatnonzero(feature[at] >= 0)
                while len(active):
                    node = at[active]
                    goes_left = x[active, feature[node]] <= threshold[node]
                    at[active] = np.where(goes_left, left[node], right[node])
                    active = active[feature[at[active]] >= 0]
                depth += path[at]
            yield pd.DataFrame({key: batch[key], "score": np.power(2.0, -depth / (len(packed) * expected))})

    rows = spread(df.select(key, *[F.coalesce(C.as_number(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)]))
    return rows.mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def isolation_forest(
    df: DataFrame, key: str, names: list[str], contamination: float = 0.1, trees: int = 100, seed: int = 42
) -> DataFrame:
    """(key, score, outlier): rows scored above the contamination quantile."""
    forest = grow_forest(df, key, names, trees, seed)
    scored = materialize(score_forest(df, key, names, forest, df.count()), "iforest")
    cut = exact_quantiles(scored, ["score"], [1.0 - contamination])["score"][0]
    return scored.withColumn("outlier", F.col("score") > C.literal(cut))


def isolation_forest_by_column(df: DataFrame, key: str, names: list[str], **options) -> DataFrame:
    """(column, key, score, outlier): one forest per column, missing values left out."""
    from functools import reduce

    parts = []
    for c in names:
        kept = df.where(~C.is_missing(df, c))
        parts.append(isolation_forest(kept, key, [c], **options).withColumn("column_name", F.lit(c)))
    return reduce(DataFrame.unionByName, parts)
