"""Combining models over a long predictions table (row, model, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.functions import columns as C
from loomframe.operators import metrics, models, split
from loomframe.session import materialize


def top_trials(trials: DataFrame, k: int = 3) -> DataFrame:
    """The k best completed trials; with fewer than two, the single best."""
    done = trials.where(F.col("status") == "completed")
    return done.orderBy(F.desc("score"), "trial_id").limit(k)


def vote_soft(probs: DataFrame, key: str, label: str = "class", score: str = "p") -> DataFrame:
    """Class with the largest mean probability, ties to the smallest class."""
    # one shuffle on the row key serves both aggregates
    means = probs.repartition(key).groupBy(key, label).agg(F.round(F.avg(score), 12).alias("m"))
    best = F.min_by(label, F.struct((-F.col("m")).alias("m"), F.col(label).alias("c")))
    return means.groupBy(key).agg(best.alias("pred"))


def vote_hard(preds: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    votes = preds.repartition(key).groupBy(key, pred).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(pred, F.struct((-F.col("n")).alias("n"), F.col(pred).alias("c")))
    return votes.groupBy(key).agg(best.alias("pred"))


def vote_mean(preds: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    return preds.groupBy(key).agg(F.avg(pred).alias("pred"))


def score_weights(scores: DataFrame, model: str = "model", score: str = "score") -> dict[str, float]:
    """Weights score / sum of scores; equal weights when the sum is zero."""
    rows = scores.select(model, score).collect()  # one row for each model
    total = sum(r[score] for r in rows)
    return {r[model]: (r[score] / total if total else 1.0 / len(rows)) for r in rows}


def _weight(weights: dict[str, float], model: str) -> Column:
    table = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
    return F.element_at(table, F.col(model))


def blend_weighted(preds: DataFrame, key: str, weights: dict[str, float], model: str = "model", pred: str = "pred", classes: bool = False) -> DataFrame:
    """Weighted mean of predictions; classes are rounded half to even."""
    w = _weight(weights, model)
    mean = C.safe_divide(F.sum(w * F.col(pred)), F.sum(w))
    out = preds.groupBy(key).agg(mean.alias("pred"))
    return out.withColumn("pred", F.bround("pred", 0).cast("bigint")) if classes else out


def blend_proba(probs: DataFrame, key: str, weights: dict[str, float], model: str = "model", label: str = "class", score: str = "p") -> DataFrame:
    """Weighted mean probability per class over the models that gave one."""
    kept = probs.where(F.col(score).isNotNull())
    w = _weight(weights, model)
    return kept.groupBy(key, label).agg(C.safe_divide(F.sum(w * F.col(score)), F.sum(w)).alias("p"))


def diversity_weights(preds: DataFrame, key: str, task: str, model: str = "model", pred: str = "pred") -> DataFrame:
    """Weight per model: summed disagreement with the others, normalised.

    Predictions are laid side by side by one aggregate on the row key, and a
    second aggregate compares all model pairs; pairs of rows never exist.
    """
    names = [r[model] for r in preds.select(model).distinct().collect()]
    names.sort()
    wide = preds.groupBy(key).pivot(model, names).agg(F.first(pred))
    pairs = [(a, b) for a in names for b in names if a != b]
    if task == "classification":
        exprs = [(1 - F.avg((F.col(f"`{a}`") == F.col(f"`{b}`")).cast("double"))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    else:
        exprs = []
        for i, (a, b) in enumerate(pairs):
            both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
            x, y = F.when(both, F.col(f"`{a}`").cast("double")), F.when(both, F.col(f"`{b}`").cast("double"))
            exprs.append(F.try_divide(F.avg((x - y) * (x - y)), F.var_pop(x)).alias(f"d{i}"))
    row = wide.agg(*exprs)
    rows = []
    for m in names:
        total = F.lit(0.0)
        for i, (a, _) in enumerate(pairs):
            if a == m:
                total = total + F.coalesce(F.col(f"d{i}"), F.lit(0.0))
        rows.append({"model": F.lit(m), "diversity": total, "n_models": F.lit(len(names))})
    long = C.inline_rows(row, rows)
    # a window over one row per model
    everything = F.sum("diversity").over(Window.partitionBy())
    weight = F.when(everything != 0, F.col("diversity") / everything).otherwise(1.0 / F.col("n_models"))
    return long.select("model", "diversity", weight.alias("weight"))


def stack(
    df: DataFrame, key: str, features: list[str], label: str, task: str, bases: dict[str, tuple[str, dict]], k: int = 5, seed: int = 42
) -> DataFrame:
    """Out-of-fold base predictions, then a linear or logistic meta model."""
    folded = split.folds_stratified(df, key, label, k, seed) if task == "classification" else split.folds_plain(df, key, k, seed)
    folded = materialize(folded.select(key, *features, label, "fold"), "stack")
    oof = materialize(models.out_of_fold(folded, key, features, label, task, bases, k), "stack-oof")
    wide = oof.groupBy(key, label).pivot("model", list(bases)).agg(F.first("pred"))
    family = "logistic_regression" if task == "classification" else "linear_regression"
    params = {"max_iter": 100} if task == "classification" else {}
    meta = models.fit_model(wide, list(bases), label, family, task, params)
    return models.predict(wide, meta, [key, label])


def ensemble_cv(
    df: DataFrame, key: str, features: list[str], label: str, task: str, bases: dict[str, tuple[str, dict]], k: int = 5, seed: int = 42
) -> DataFrame:
    """Per fold accuracy or R2 of the voting ensemble on held-out rows."""
    folded = split.folds_stratified(df, key, label, k, seed) if task == "classification" else split.folds_plain(df, key, k, seed)
    folded = materialize(folded.select(key, *features, label, "fold"), "ensemble-cv")
    oof = models.out_of_fold(folded, key, features, label, task, bases, k)
    voted = (vote_hard if task == "classification" else vote_mean)(oof, key)
    truth = folded.select(key, F.col(label).alias("y"), "fold")
    joined = truth.join(voted, key)
    if task == "classification":
        return joined.groupBy("fold").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("score"))
    return metrics.regression_errors(joined, "y", "pred", ["fold"]).select("fold", F.col("r2").alias("score"))
