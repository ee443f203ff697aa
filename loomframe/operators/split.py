"""Seeded splits, folds and class weights, stable under repartitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.ordering import seeded_rank


def split_stratified(df: DataFrame, key: str, target: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` marks the first share of each class in seeded order."""
    ranked = seeded_rank(df, seed, key, by=[target], out="__rn")
    sizes = df.groupBy(F.col(target).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(sizes, F.col(target).eqNullSafe(F.col("__t")))
    return joined.withColumn("is_test", F.col("__rn") <= F.round(F.col("__n") * F.lit(float(test_share)))).drop("__rn", "__t", "__n")


def folds_stratified(df: DataFrame, key: str, target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds by round robin over the seeded order of each class."""
    ranked = seeded_rank(df, seed, key, by=[target], out="__rn")
    return ranked.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__rn")


def folds_plain(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds by hash: a projection, no ordering and no shuffle."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df.withColumn("fold", C.hash_bucket(text, k).cast("int"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class: n / (classes * n_class)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("n"))
    return counts.select("class", "n", weight.alias("weight"))


def weight_column(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(F.col("class").alias("__c"), F.col("weight").alias(out))
    return df.join(weights, F.col(target) == F.col("__c"), "left").drop("__c")
