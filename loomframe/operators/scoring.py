"""Batch, file and stream scoring share one transform."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from loomframe.operators.preprocess import Preprocessor, apply_preprocessor


def score(
    df: DataFrame, model: PipelineModel, key: str, preprocessor: Preprocessor | None = None, n_classes: int = 0, run_id: str = "", name: str = ""
) -> DataFrame:
    """(key, prediction, probability_class_i, run, model) for any table or stream."""
    ready = apply_preprocessor(df, preprocessor) if preprocessor else df
    out = model.transform(ready)
    columns = [F.col(key), F.col("prediction")]
    if n_classes and "probability" in out.columns:
        p = vector_to_array("probability")
        columns += [F.get(p, F.lit(i)).alias(f"probability_class_{i}") for i in range(n_classes)]
    return out.select(*columns, F.lit(run_id).alias("run_id"), F.lit(name).alias("model_name"))


def score_file(
    spark, source: str, sink: str, schema: str, model: PipelineModel, key: str, preprocessor: Preprocessor | None = None, n_classes: int = 0
) -> DataFrame:
    """CSV in, CSV with predictions out; returns the written rows."""
    from loomframe.sources.tables import read_table, write_table

    rows = read_table(spark, source, "csv", schema=schema)
    scored = score(rows, model, key, preprocessor, n_classes)
    write_table(scored, sink, "csv")
    return read_table(spark, sink, "csv", schema=scored.schema)
