"""Stored leaderboards, metric logs, run metadata and models."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

PARAMS = "map<string,string>"


def write_leaderboard(trials: DataFrame, path: str) -> None:
    """Ranked trials as CSV with the parameters as JSON text."""
    trials.withColumn("params", F.to_json("params")).write.option("header", True).option("escape", '"').csv(path)


def read_leaderboard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored trials, best score first; parameters are parsed, never evaluated."""
    rows = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return rows.withColumn("params", F.from_json("params", PARAMS)).orderBy(F.desc("score"), "trial_id")


def append_metrics(rows: DataFrame, path: str) -> None:
    """Evaluations join the log; nothing that was logged is overwritten."""
    rows.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_runs(runs: DataFrame, path: str) -> None:
    """Run documents as JSON lines; many runs share a file."""
    runs.write.mode("append").json(path)


def load_run(spark: SparkSession, path: str, schema, run_id: str) -> DataFrame:
    return spark.read.schema(schema).json(path).where(F.col("run_id") == run_id)


def list_artifacts(spark: SparkSession, path: str, schema) -> DataFrame:
    """All stored runs with the file they lie in, newest first."""
    runs = spark.read.schema(schema).json(path)
    return runs.withColumn("file_path", F.col("_metadata.file_path")).orderBy(F.desc("created"), F.desc("run_id"))


def retention(runs: DataFrame, keep: int = 10) -> DataFrame:
    """Runs older than the newest ``keep``; the list only, nothing is deleted.

    The newest rows come from a top-k; the rest is an anti join against those
    few keys, so the run table is neither sorted nor put in one task.
    """
    newest = runs.orderBy(F.desc("created"), F.desc("run_id")).limit(keep).select("run_id")
    return runs.join(F.broadcast(newest), "run_id", "left_anti")


def save_preprocessor(spark: SparkSession, state, path: str) -> None:
    """Fitted preprocessing state as one JSON document next to the model."""
    spark.createDataFrame([(json.dumps(asdict(state)),)], "value string").coalesce(1).write.text(path)


def load_preprocessor(spark: SparkSession, path: str):
    from loomframe.operators.preprocess import Preprocessor

    return Preprocessor(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def save_card(card: DataFrame, path: str) -> None:
    """A model card as Markdown text."""
    card.select(F.col("card").alias("value")).coalesce(1).write.text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
