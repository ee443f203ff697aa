"""Rows named by identifier and text, so that rows sharing an identifier are told apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.membership import build, perhaps
from loomframe.session import materialize


def text_key(text: Column) -> Column:
    """64 bits that name a text; the null text has its own."""
    return F.xxhash64(text.cast("string"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``docs`` has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def drop_rows(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in ``bad`` (id, text_key).

    A filter passes on what is surely not in ``bad``, so that only few texts are
    shuffled for the exact join. All rows that agree with one in ``bad`` go, repeated
    ones too; null identifiers and null texts are values like any other, empty and long
    texts too. An empty table gives an empty result. Other columns pass through,
    whatever their names.
    """
    bad_id, bad_key, own_id, own_key, maybe = free_names(docs, "__bad_id", "__bad_key", "__id", "__key", "__maybe")
    bad = materialize(bad.select(F.col("id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "rows-to-drop")
    bits = build(bad.select(F.xxhash64(bad_id, bad_key)), bad.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_be(key: pd.Series) -> pd.Series:
        return pd.Series(perhaps(shared.value, key.to_numpy()))

    marked = docs.withColumn(own_id, F.col(id_col).cast("long")).withColumn(own_key, text_key(F.col(text_col)))
    marked = marked.withColumn(maybe, may_be(F.xxhash64(own_id, own_key)))
    same = F.col(own_id).eqNullSafe(F.col(bad_id)) & (F.col(own_key) == F.col(bad_key))
    kept = marked.filter(F.col(maybe)).join(bad, same, "left_anti")
    return marked.filter(~F.col(maybe)).unionByName(kept).select(*docs.columns)
