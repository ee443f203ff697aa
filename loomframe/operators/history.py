"""Leaderboards, run history, metric history and usage audits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.functions.ordering import global_row_number

# Weights of the similarity terms.
SIMILARITY_WEIGHTS = {
    "task_type": 0.3,
    "n_features": 0.2,
    "n_rows": 0.1,
    "n_numeric": 0.1,
    "n_categorical": 0.1,
    "missing_ratio": 0.1,
    "class_balance": 0.1,
}


def completed(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("status") == "completed")


def leaderboard_rank(trials: DataFrame, **options) -> DataFrame:
    """Completed trials ranked from 1, best score first, ties by trial id."""
    return global_row_number(completed(trials), [("score", "desc"), ("trial_id", "asc")], "rank", **options)


def leaderboard_top(trials: DataFrame, n: int = 10) -> DataFrame:
    return completed(trials).orderBy(F.desc("score"), "trial_id").limit(n)


def leaderboard_by_model(trials: DataFrame, model: str) -> DataFrame:
    return completed(trials).where(F.col("model_type") == model)


def leaderboard_stats(trials: DataFrame) -> DataFrame:
    return completed(trials).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.max("score").alias("best_score"),
        F.min("score").alias("worst_score"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.avg("fit_time").alias("mean_fit_time"),
        F.avg("predict_time").alias("mean_predict_time"),
        F.array_join(F.array_sort(F.collect_set("model_type")), ",").alias("models"),
    )


def leaderboard_model_stats(trials: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per-model statistics, optionally for a subset of models."""
    kept = completed(trials) if names is None else completed(trials).where(F.col("model_type").isin(names))
    return kept.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.max("score").alias("best_score"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.avg("fit_time").alias("mean_fit_time"),
    )


def upsert_runs(stored: DataFrame, changes: DataFrame, key: str = "run_id", version: str = "version") -> DataFrame:
    """Latest version of each run; a map-side maximum, so a hot run is cheap."""
    both = stored.unionByName(changes)
    others = [c for c in both.columns if c != key]
    order = F.struct(F.col(version), *[F.col(c) for c in others if c != version])
    return both.groupBy(key).agg(F.max(order).alias("__r")).select(key, "__r.*").select(*stored.columns)


def similarity(profile: dict) -> Column:
    """Weighted likeness of a run row to a profile.

    A term counts only when both sides have it; counts of zero are absent.
    """
    gained, possible = F.lit(0.0), F.lit(0.0)
    for name, weight in SIMILARITY_WEIGHTS.items():
        mine = profile.get(name)
        column = F.col(name)
        if name == "task_type":
            if not mine:
                continue
            usable = column.isNotNull() & (column != "")
            likeness = (column == F.lit(mine)).cast("double")
        elif name in ("missing_ratio", "class_balance"):
            if mine is None:
                continue
            usable = column.isNotNull()
            likeness = 1.0 - F.abs(F.lit(float(mine)) - column)
        else:
            if not mine:
                continue
            usable = column.isNotNull() & (column != 0)
            likeness = 1.0 - F.abs(F.lit(float(mine)) - column) / F.greatest(F.lit(float(mine)), column.cast("double"))
        gained = gained + F.when(usable, F.lit(weight) * likeness).otherwise(0.0)
        possible = possible + F.when(usable, F.lit(weight)).otherwise(0.0)
    return F.when(possible > 0, gained / possible).otherwise(0.0)


def similar_runs(runs: DataFrame, profile: dict, k: int = 5) -> DataFrame:
    """The k runs most like the profile; one projection and a top-k."""
    scored = runs.withColumn("similarity", F.round(similarity(profile), 9))
    return scored.orderBy(F.desc("similarity"), "run_id").limit(k)


def profile_record(profile_row) -> dict:
    """A ``dataset_profile`` row in the terms of the run store."""
    return {
        "task_type": profile_row["task_type"],
        "n_features": profile_row["n_cols"],
        "n_rows": profile_row["n_rows"],
        "n_numeric": profile_row["n_numeric"],
        "n_categorical": profile_row["n_categorical"],
        "missing_ratio": profile_row["missing_ratio"],
        "class_balance": profile_row["class_balance"],
    }


def best_params_by_model(runs: DataFrame) -> DataFrame:
    best = F.max_by("best_params", F.struct("best_score", F.col("run_id")))
    return runs.groupBy("best_model").agg(best.alias("params"), F.max("best_score").alias("score"))


def stored_params(runs: DataFrame, model: str) -> dict | None:
    """Best parameters of one model as a dictionary (JSON in the store)."""
    row = best_params_by_model(runs.where(F.col("best_model") == model)).first()
    return json.loads(row["params"]) if row and row["params"] else None


def run_statistics(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.array_join(F.array_sort(F.collect_set("task_type")), ",").alias("task_types"),
        F.array_join(F.array_sort(F.collect_set("best_model")), ",").alias("model_types"),
        (F.coalesce(F.sum("best_score"), F.lit(0.0)) / F.count(F.lit(1))).alias("avg_score"),
    )


def history_summary(log: DataFrame, last_n: int | None = None) -> DataFrame:
    """Size, time range, models and runs of the whole log or its newest rows."""
    rows = log if last_n is None else log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last_n)
    return rows.agg(
        F.count(F.lit(1)).alias("total_metrics"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_distinct("model_name").alias("n_models"),
        F.count_distinct("run_id").alias("n_runs"),
    )


def history_averages(log: DataFrame, names: list[str]) -> DataFrame:
    exprs, rows = [], []
    for i, c in enumerate(names):
        x = C.as_number(log, c)
        exprs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count(x).alias(f"n{i}")]
        rows.append({"metric": F.lit(c), "n": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}")})
    return C.inline_rows(log.agg(*exprs), rows).where("n > 0")


def history_trend(log: DataFrame, model: str, names: list[str], **options) -> DataFrame:
    """Numbered evaluations of one model in time order."""
    mine = log.where(F.col("model_name") == model).select("event_id", "ts", *names)
    return global_row_number(mine, [("ts", "asc"), ("event_id", "asc")], "seq", **options)


def performance_summary(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(F.col(name).alias("name")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def key_usage_audit(log: DataFrame, key: str, allowed: Column, ts: str) -> DataFrame:
    """Per key: requests, permitted uses and the time of the last permitted use."""
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(allowed).alias("usage_count"), F.max(F.when(allowed, F.col(ts))).alias("last_used")
    )
