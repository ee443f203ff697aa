"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir), returns a DataFrame, and is written and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.common import read
from loomframe.llm.exact_dedup import drop_copies
from loomframe.llm.jaccard import near_duplicates
from loomframe.llm.packing import default_tokenizer, pack
from loomframe.llm.rows import drop_rows
from loomframe.llm.secrets import redact
from loomframe.llm.toxicity import score_toxicity
from loomframe.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all others stay as they are."""
    verdicts = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return drop_rows(docs, verdicts.filter("predicted = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in case at most, the largest identifier stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest identifier stays."""
    found = near_duplicates(docs)
    return drop_rows(docs, found.filter("component_id < id"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens."""
    return pack(docs, default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: SQL has neither the classifier nor the tokenizer; the tests hold the pipeline against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
