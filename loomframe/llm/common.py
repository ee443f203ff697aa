"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Texts handed to a Python worker at once.
TEXT_ROWS = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the space and the controls 9 to 13.
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with its SQL equivalent, if it has one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns cannot clash.

    Texts reach Python in batches of TEXT_ROWS, which bounds what a worker and its
    executor hold of them at once.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)
