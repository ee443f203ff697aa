"""Exact attributions of tree models: what each feature adds to a prediction.

A fitted Spark ML tree model is read as a table of nodes. For the rows of a batch, a
feature that is not in a coalition follows both sides of a split in proportion to the
training rows there; the contribution of a feature is its Shapley value in that game.
Every leaf plays a game of its own, in which only the features on its path take part
and each either lets a row through or not. So a leaf's contributions depend on one bit
a feature, and are a look-up in a table made once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomframe.functions import columns as C
from loomframe.session import scratch_path

# features on a path up to which the table of all 2^n bits is made
TABLE_FEATURES = 8


@dataclass
class Leaf:
    """Value and path of a leaf: for each feature the range it must lie in, and the share of rows that its splits let through."""

    value: float
    above: dict[int, float] = field(default_factory=dict)
    upto: dict[int, float] = field(default_factory=dict)
    share: dict[int, float] = field(default_factory=dict)

    def step(self, feature: int, threshold: float, left: bool, share: float) -> "Leaf":
        above, upto = dict(self.above), dict(self.upto)
        if left:
            upto[feature] = min(threshold, upto.get(feature, np.inf))
        else:
            above[feature] = max(threshold, above.get(feature, -np.inf))
        return Leaf(0.0, above, upto, self.share | {feature: self.share.get(feature, 1.0) * share})


@dataclass
class LeafGroup:
    """Leaves with equally many features on their paths, side by side."""

    value: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray
    table: np.ndarray | None


def node_table(spark: SparkSession, fitted) -> DataFrame:
    """(tree, id, value columns, children, split) of a tree or an ensemble, as Spark stores it."""
    path = scratch_path(spark, "nodes")
    fitted.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    return rows.select(F.col("treeID").alias("tree"), "nodeData.*") if "nodeData" in rows.columns else rows.select(F.lit(0).alias("tree"), "*")


def read_leaves(spark: SparkSession, fitted, target_class: int = 1) -> list[Leaf]:
    """Leaves of all trees; their values add up to the output.

    The output is the prediction of a regression, the probability of ``target_class`` of
    a forest or a tree, and the log-odds of class 1 of a boosted classifier.
    """
    name = type(fitted).__name__
    if not name.endswith(("TreeRegressionModel", "TreeClassificationModel", "ForestRegressionModel", "ForestClassificationModel", "GBTRegressionModel", "GBTClassificationModel")):
        raise ValueError(f"{name} is no tree model of Spark ML")
    # the model itself, which the driver holds anyway
    trees: dict[int, dict[int, dict]] = {}
    for row in node_table(spark, fitted).collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row.asDict(recursive=True)
    weights = getattr(fitted, "treeWeights", [1.0])
    if name.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    elif name == "GBTClassificationModel":
        weights = [2.0 * w for w in weights]  # Spark reads 1 / (1 + exp(-2 sum)) as the probability
    by_class = name in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")
    leaves = []
    for number, nodes in trees.items():
        todo = [(0, Leaf(0.0))]
        while todo:
            at, leaf = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = stats[target_class] / sum(stats) if by_class else node["prediction"]
                leaf.value = weights[number] * value
                leaves.append(leaf)
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("splits of categories are not read; assemble plain numbers")
            # weights: of the classes, else the first of the moments; a training row may stand for many
            stats = [nodes[node[side]]["impurityStats"] for side in ("leftChild", "rightChild")]
            rows = [sum(x) if by_class else x[0] for x in stats]
            for side, left, n in (("leftChild", True, rows[0]), ("rightChild", False, rows[1])):
                todo.append((node[side], leaf.step(split["featureIndex"], split["leftCategoriesOrThreshold"][0], left, n / (sum(rows) or 1))))
    return leaves


def shapley_of_bits(share: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Contributions to one leaf of value 1, for shares (leaves, 1, n) and bits (leaves or 1, patterns, n).

    A coalition of a given size weighs alike wherever it occurs, so for each feature the
    products over all coalitions of the others are summed by size, feature by feature.
    """
    n = share.shape[-1]
    out = np.zeros(np.broadcast_shapes(share.shape, bits.shape))
    weight = np.array([factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)])
    for j in range(n):
        sums = np.zeros((*out.shape[:-1], n))
        sums[..., 0] = 1.0
        for i in range(n):
            if i != j:
                grown = sums * share[..., i : i + 1]
                grown[..., 1:] += sums[..., :-1] * bits[..., i : i + 1]
                sums = grown
        out[..., j] = (bits[..., j] - share[..., j]) * (sums @ weight)
    return out


def group_leaves(leaves: list[Leaf]) -> tuple[float, list[LeafGroup]]:
    """The output expected without any feature, and the leaves by the number of their features."""
    base, groups = 0.0, {}
    for leaf in leaves:
        base += leaf.value * float(np.prod(list(leaf.share.values())))
        if leaf.share:
            groups.setdefault(len(leaf.share), []).append(leaf)
    made = []
    for n, members in sorted(groups.items()):
        paths = [sorted(x.share) for x in members]
        of = lambda get: np.array([[get(x, f) for f in path] for x, path in zip(members, paths)])
        value, share = np.array([x.value for x in members]), of(lambda x, f: x.share[f])
        table = None
        if n <= TABLE_FEATURES:
            bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
            table = shapley_of_bits(share[:, None, :], bits[None].astype(float)) * value[:, None, None]
        made.append(LeafGroup(value, np.array(paths), of(lambda x, f: x.above.get(f, -np.inf)), of(lambda x, f: x.upto.get(f, np.inf)), share, table))
    return base, made


def contributions(x: np.ndarray, groups: list[LeafGroup]) -> np.ndarray:
    """What each feature adds to the output of each row."""
    out = np.zeros(x.shape)
    for group in groups:
        n = group.feature.shape[1]
        powers = 1 << np.arange(n)
        for k, path in enumerate(group.feature):
            own = x[:, path]
            # as the trees do: what is not at most the threshold, a missing value too, goes right
            through = ((own <= group.upto[k]) | np.isposinf(group.upto[k])) & (~(own <= group.above[k]) | np.isneginf(group.above[k]))
            pattern = through @ powers
            if group.table is not None:
                out[:, path] += group.table[k][pattern]
            else:
                seen, back = np.unique(pattern, return_inverse=True)
                bits = ((seen[:, None] >> np.arange(n)) & 1).astype(float)
                out[:, path] += (shapley_of_bits(group.share[k][None, :], bits) * group.value[k])[back]
    return out


def tree_attributions(df: DataFrame, key: str, features: list[str], model: PipelineModel, target_class: int = 1, wanted: Column | None = None) -> DataFrame:
    """(key, base, output, feature, value, contribution) of every row, or of the ``wanted`` ones.

    ``base`` and the contributions add up to ``output``; read_leaves says what that is.
    Rows are only mapped, nothing is shuffled.
    """
    spark = df.sparkSession
    base, groups = group_leaves(read_leaves(spark, model.stages[-1], target_class))
    shared = spark.sparkContext.broadcast(groups)
    # features that the model cuts into bins before its trees see them
    cuts = {features.index(s.getInputCol()): np.array(s.getSplits()[1:-1]) for s in model.stages if isinstance(s, Bucketizer)}
    chosen = df if wanted is None else df.where(wanted)
    rows = chosen.select(F.col(key).alias("key"), *[C.as_number(df, c).alias(f"x{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]])
            seen = x.copy()
            for i, edges in cuts.items():
                seen[:, i] = np.where(np.isnan(x[:, i]), np.nan, np.searchsorted(edges, x[:, i], side="right"))
            parts = contributions(seen, shared.value)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), from_pandas=True))
            yield pa.record_batch([batch.column(0), pa.array(base + parts.sum(axis=1)), lists(x), lists(parts)], names=["key", "output", "x", "parts"])

    kind = df.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(run, f"key {kind}, output double, x array<double>, parts array<double>")
    each = F.inline(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("x").alias("value"), F.col("parts").alias("contribution")))
    return scored.select(F.col("key").alias(key), F.lit(base).alias("base"), "output", each).toDF(key, "base", "output", "feature", "value", "contribution")
