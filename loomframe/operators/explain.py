"""Importances, attributions and model cards."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.ordering import MIX_ROUNDS, permutation_keys, permuted, seeded_rank
from loomframe.operators import metrics, models, quality
from loomframe.session import materialize


def builtin_importance(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree importances or absolute coefficients, largest first."""
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficientMatrix"):
        values = np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(fitted, "coefficients"):
        values = np.abs(fitted.coefficients.toArray())
    else:
        raise ValueError(f"{type(fitted).__name__} has no built-in importance")
    rows = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def _score(metric: str, y: str) -> Column:
    if metric == "accuracy":
        return F.avg((F.col(y) == F.col("pred")).cast("double"))
    gap = F.col(y) - F.col("pred")
    return 1 - F.avg(gap * gap) / F.var_pop(F.col(y))


def permutation_importance(
    df: DataFrame,
    key: str,
    features: list[str],
    y: str,
    predict: Callable[[DataFrame], DataFrame],
    metric: str = "r2",
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Mean and spread of the score drop when one feature is shuffled.

    Rows are ranked once in seeded hash order. For each feature and repeat a keyed
    bijection says to which rank a row's value goes, so only (rank, value) moves, and
    rows meet all values meant for them in one join. ``predict`` adds a ``pred``
    column, so an expression and a fitted model both fit.
    """
    base = df.select(key, y, *features)
    reference = predict(base).agg(_score(metric, y).alias("s")).first()["s"]
    # read by both sides of the join
    ranked = materialize(seeded_rank(base, seed, key, out="rn").withColumn("place", F.col("rn") - 1).drop("rn"), "permutation")
    n_rows = ranked.count()
    turns = [(f, r) for f in features for r in range(repeats)]
    names = [(f"k{i}", f"add{i}", f"last{i}") for i in range(MIX_ROUNDS)]
    rows = []
    for i, (f, r) in enumerate(turns):
        keys = [F.lit(x).cast("long").alias(c) for part, triple in zip(names, permutation_keys(f"{seed}:{r}:{f}")) for c, x in zip(part, triple)]
        rows.append(F.struct(F.lit(i).alias("turn"), *keys, F.col(f).cast("double").alias("value")))
    goal = permuted(F.col("place"), n_rows, [tuple(F.col(c) for c in part) for part in names])
    moves = ranked.select("place", F.inline(F.array(*rows))).select(goal.alias("to"), "turn", "value")
    # a value for each feature and repeat
    given = moves.groupBy("to").agg(F.map_from_entries(F.collect_list(F.struct("turn", "value"))).alias("given"))
    # both sides grow with the table, and files tell too little of the size of rows in memory: not sent whole through the driver
    met = ranked.hint("merge").join(given, F.col("place") == F.col("to"))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for i, (f, r) in enumerate(turns)]))
    mixed = met.select(key, y, *features, "given", each).withColumn("donor", F.element_at("given", F.col("turn"))).drop("given")
    swapped = mixed.withColumns({f: F.when(F.col("feature") == f, F.col("donor")).otherwise(F.col(f)) for f in features})
    drops = predict(swapped).groupBy("feature", "repeat").agg((F.lit(reference) - _score(metric, y)).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def plot_data(importances: DataFrame, k: int = 20, title: str = "Feature importance") -> DataFrame:
    """One row with ordered arrays for a bar chart of the first k features."""
    top = top_features(importances, k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("s"), "feature", "importance")))
    return top.agg(ordered.alias("o")).select(
        F.transform("o", lambda x: x["feature"]).alias("features"),
        F.transform("o", lambda x: x["importance"]).alias("values"),
        F.lit(title).alias("title"),
    )


def compare_importances(named: dict[str, DataFrame | Exception]) -> DataFrame:
    """Importance per feature and model side by side; failures kept as a model with nulls."""
    good = {m: d for m, d in named.items() if isinstance(d, DataFrame)}
    long = reduce(DataFrame.unionByName, [d.select("feature", "importance").withColumn("model", F.lit(m)) for m, d in good.items()])
    wide = long.groupBy("feature").pivot("model", list(good)).agg(F.first("importance"))
    return wide.withColumns({m: F.lit(None).cast("double") for m in named if m not in good})


def _linear_parts(df: DataFrame, weights: dict[str, float]) -> dict[str, Column]:
    means = C.wide_aggregate(df, [F.avg(C.as_number(df, c)).alias(c) for c in weights])
    return {c: F.lit(float(w)) * (C.as_number(df, c) - C.literal(means[c])) for c, w in weights.items()}


def attribution_summary(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, top: int = 10) -> DataFrame:
    """Exact linear contributions w (x - mean): mean size, spread, base value."""
    parts = _linear_parts(df, weights)
    exprs = [F.avg(C.as_number(df, c)).alias(f"__m{i}") for i, c in enumerate(weights)]
    for i, value in enumerate(parts.values()):
        exprs += [F.avg(F.abs(value)).alias(f"__a{i}"), F.stddev_pop(value).alias(f"__s{i}")]
    base = F.lit(float(intercept))
    for i, w in enumerate(weights.values()):
        base = base + F.lit(float(w)) * F.col(f"__m{i}")
    rows = [
        {"feature": F.lit(c), "mean_abs": F.col(f"__a{i}"), "std": F.col(f"__s{i}"), "base_value": base} for i, c in enumerate(weights)
    ]
    return C.inline_rows(df.agg(*exprs), rows).orderBy(F.desc("mean_abs"), "feature").limit(top)


def explain_instances(df: DataFrame, key: str, wanted: Column, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Prediction and contribution of each feature for the chosen rows, long form.

    The means come from the whole table; the filter reaches the scan.
    """
    parts = _linear_parts(df, weights)
    prediction = F.lit(float(intercept))
    for c, w in weights.items():
        prediction = prediction + F.lit(float(w)) * C.as_number(df, c)
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), C.as_number(df, c).alias("value"), v.alias("contribution")) for c, v in parts.items()]
    )
    return df.where(wanted).select(F.col(key), prediction.alias("prediction"), F.inline(rows))


def sampled_attributions(
    df: DataFrame, key: str, features: list[str], model: PipelineModel, output: Callable[[DataFrame], Column], samples: int = 8, seed: int = 42, wanted: Column | None = None
) -> DataFrame:
    """(key, feature, contribution) by sampled Shapley values for any model; of the ``wanted`` rows only, if given.

    Each row is scored at the prefixes of a few feature orders, the rest of
    the features held at background rows (a bounded, hashed sample).  Scoring
    is ``model.transform``; a step adds its score to the feature it sets and
    takes it from the feature set next.
    """
    ground = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(samples).select(*features).collect()
    rng = random.Random(seed)
    orders = [rng.sample(range(len(features)), len(features)) for _ in range(samples)]
    plans = F.array(
        *[
            F.struct(
                F.array(*[F.lit(j) for j in order]).alias("order"),
                F.array(*[F.lit(float(ground[i % len(ground)][f] or 0.0)) for f in features]).alias("ground"),
            )
            for i, order in enumerate(orders)
        ]
    )
    chosen = df if wanted is None else df.where(wanted)
    steps = chosen.select(key, *[C.as_number(df, f).alias(f) for f in features]).withColumn("plan", F.explode(plans))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = steps.withColumns(
        {
            f: F.when(F.array_position("plan.order", j) <= F.col("step"), F.col(f)).otherwise(F.get("plan.ground", F.lit(j)))
            for j, f in enumerate(features)
        }
    )
    scored = model.transform(mixed)
    scored = scored.select(key, "plan", "step", output(scored).alias("out"))
    names = F.array(*[F.lit(f) for f in features])
    gain = F.when(F.col("step") >= 1, F.struct(F.get(names, F.get("plan.order", F.col("step") - 1)).alias("feature"), F.col("out").alias("part")))
    loss = F.when(F.col("step") < len(features), F.struct(F.get(names, F.get("plan.order", F.col("step"))).alias("feature"), (-F.col("out")).alias("part")))
    moves = scored.select(key, F.inline(F.filter(F.array(gain, loss), lambda s: s.isNotNull())))
    return moves.groupBy(key, "feature").agg((F.sum("part") / samples).alias("contribution"))


def explain_fitted(
    df: DataFrame, key: str, wanted: Column, features: list[str], model: PipelineModel, task: str, target_class: int = 1, samples: int = 32, seed: int = 42
) -> DataFrame:
    """Prediction, class probabilities and contributions of chosen rows for any fitted model, long form.

    Contributions are sampled Shapley values against rows drawn from the whole
    table: of the prediction for regression, else of the probability of ``target_class``.
    """

    def output(scored: DataFrame) -> Column:
        if task == "regression":
            return F.col("prediction")
        kind = dict(scored.dtypes)["probability"]
        values = F.col("probability") if kind.startswith("array") else vector_to_array("probability")
        return F.get(values, F.lit(target_class))

    rows = models.predict(df.where(wanted), model, [key, *features]).withColumnRenamed("pred", "prediction")
    parts = sampled_attributions(df, key, features, model, output, samples, seed, wanted).withColumnRenamed(key, "__key")
    values = F.create_map(*[x for f in features for x in (F.lit(f), C.as_number(df, f))])
    shown = [c for c in ("prediction", "probability") if c in rows.columns]
    joined = rows.join(parts, rows[key] == parts["__key"])
    return joined.select(key, *shown, "feature", values[F.col("feature")].alias("value"), "contribution")


def explain_model(df: DataFrame, model: PipelineModel, features: list[str], y: str, task: str) -> DataFrame:
    """Long (section, name, value) rows: type, size, score, errors, importances."""
    spark = df.sparkSession
    # read by each section
    scored = materialize(models.predict(df, model, [y]), "explained")
    fitted = model.stages[-1]
    if task == "regression":
        tables = {"score": metrics.regression_errors(scored, y), "residuals": metrics.residual_statistics(scored, y)}
    else:
        tables = {"score": metrics.accuracy(scored, y), "weighted": metrics.prf_weighted(scored, y)}
        if "probability" in scored.columns:
            long = scored.select(F.posexplode("probability").alias("class", "p"))
            tables["probability"] = metrics.probability_summary(long)
    parts = []
    for section, row in tables.items():
        parts.append(C.inline_rows(row, [{"section": F.lit(section), "name": F.lit(c), "value": F.col(c).cast("string")} for c in row.columns]))
    facts = [("model", "type", type(fitted).__name__), ("model", "features", str(len(features)))]
    facts += [("parameter", p.name, str(v)) for p, v in fitted.extractParamMap().items()]
    parts.append(spark.createDataFrame(facts, "section string, name string, value string"))
    parts.append(df.agg(F.lit("model").alias("section"), F.lit("rows").alias("name"), F.count(F.lit(1)).cast("string").alias("value")))
    shown = builtin_importance(spark, model, features)
    parts.append(shown.select(F.lit("importance").alias("section"), F.col("feature").alias("name"), F.col("importance").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def model_card(df: DataFrame, scored: DataFrame, name: str, target: str, importances: DataFrame | None = None) -> DataFrame:
    """One Markdown string row; each section is built from Spark aggregates."""
    task = quality.task_type_of(df, target)
    spark = df.sparkSession

    def section(order: int, title: str, lines: DataFrame) -> DataFrame:
        text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda s: s["line"]))
        body = lines.agg(text.alias("body"))
        return body.select(F.lit(order).alias("o"), F.concat(F.lit(f"## {title}\n"), F.col("body")).alias("part"))

    def bullets(rows: DataFrame, label: str, value: str) -> DataFrame:
        return rows.select(
            F.col(label).cast("string").alias("o"),
            F.concat(F.lit("- "), F.col(label).cast("string"), F.lit(": "), F.format_number(F.col(value).cast("double"), 4)).alias("line"),
        )

    def tall(row: DataFrame) -> DataFrame:
        return C.inline_rows(row, [{"name": F.lit(c), "value": F.col(c).cast("double")} for c in row.columns])

    if task == "classification":
        performance = tall(metrics.accuracy(scored, target)).unionByName(tall(metrics.prf_weighted(scored, target)))
    else:
        performance = tall(metrics.regression_errors(scored, target)).unionByName(tall(metrics.residual_statistics(scored, target)))
    parts = [
        spark.createDataFrame([(0, f"# Model card: {name}\n\nTask: {task}, target: {target}\n")], "o int, part string"),
        section(1, "Performance", bullets(performance, "name", "value")),
        section(2, "Data", bullets(tall(quality.feature_statistics(df)), "name", "value")),
        section(3, "Target", bullets(quality.target_distribution(df, target, task), "name", "value")),
    ]
    if importances is not None:
        parts.append(section(4, "Top features", bullets(top_features(importances, 10), "feature", "importance")))
    notes = "## Use and limits\nScores describe the evaluated rows only. Check drift and fairness before use."
    parts.append(spark.createDataFrame([(5, notes)], "o int, part string"))
    together = reduce(DataFrame.unionByName, parts)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "part"))), lambda s: s["part"])
    return together.agg(F.concat_ws("\n\n", ordered).alias("card"))


def summary_card(df: DataFrame, name: str, task: str, score: float, n_features: int) -> DataFrame:
    """Short card: model, task, score, size."""
    rows = F.format_number(F.count(F.lit(1)), 0)
    text = F.concat(
        F.lit(f"# Model summary\n\n- model: {name}\n- task: {task}\n- score: {score:.4f}\n- features: {n_features}\n- rows: "), rows
    )
    return df.agg(text.alias("card"))
