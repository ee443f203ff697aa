"""Labels for learning, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: Column) -> Column:
    """True for the third of the documents that no model learns from; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold: id, label (0 or 1).

    The bound is the documented limit of the fitting sample; the choice follows a
    hash of the identifier. Null labels and null identifiers are left out; of
    several labels of one document the largest counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    return rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
