"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.common import fold, id_and_text
from loomframe.llm.rows import free_names
from loomframe.session import materialize

#: What must agree for two texts to count as equal: the digest names the group, the
#: length and a second, unrelated hash verify it at every level of the tree.
VERIFIED = ("digest", "n_bytes", "check")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One sorted run of digests for each partition, written once to the shared folder.

    Columns: id, row (a number of its own for each input row), run (the partition
    it came from) and VERIFIED. This is the only pass over the texts.
    """
    base = id_and_text(docs, id_col, text_col).select("id", fold(F.col("text")).alias("text"))
    rows = base.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
    )
    return materialize(rows.sortWithinPartitions(*VERIFIED), "digest-runs")


def merge_runs(runs: DataFrame, best: str, fan_in: int) -> DataFrame:
    """Merge the runs in rounds; in each one, ``fan_in`` neighbours become one run.

    A digest has one row for each run that holds it: its best (id, row) and its
    count. Rows of one run meet before they move, so that even a digest that
    fills a third of the table costs each task a single row a round.
    """
    pick = F.max if best == "largest" else F.min
    whole = runs.select("run", *VERIFIED, F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("copies"))
    top = runs.agg(F.max("run")).first()[0] or 0
    while True:
        whole = whole.groupBy("run", *VERIFIED).agg(pick("best").alias("best"), F.sum("copies").alias("copies"))
        if top == 0:
            return whole.drop("run")
        top //= fan_in
        whole = whole.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best: str = "largest", fan_in: int = 64, salts: int = 16) -> DataFrame:
    """Which row stays for each group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    ``best`` names the identifier that stays, "largest" or "smallest". Returns one
    row per input row: id, keep_id, group_size, kept, text_sha256.

    Null identifiers are the smallest ones. Rows that repeat an identifier and a
    text are copies like any other; exactly one row of each group is kept. An
    empty table gives an empty result; columns other than the two are not read.
    """
    runs = digest_runs(docs, id_col, text_col)
    merged = materialize(merge_runs(runs, best, fan_in), "digest-groups")
    alone = F.col("copies") == 1
    # Most texts have one copy: their verdict is complete as it stands.
    single = merged.filter(alone).select("digest", F.col("best.id").alias("id"), F.col("best.id").alias("keep_id"), "copies", F.lit(True).alias("kept"))
    # The others are joined over salted keys: a group of any size is spread over the salts.
    salt = lambda row: F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")
    groups = merged.filter(~alone).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    several = (
        runs.withColumn("salt", salt(F.col("row")))
        .join(groups, [*VERIFIED, "salt"])
        .select("digest", "id", F.col("best.id").alias("keep_id"), "copies", (F.col("row") == F.col("best.row")).alias("kept"))
    )
    return single.unionByName(several).select("id", "keep_id", F.col("copies").alias("group_size"), "kept", _hex(F.col("digest")))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest)).alias("text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best: str = "largest") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Rows that agree in identifier and text beyond case are one document; one of
    them stays. Null texts count as empty, null identifiers as one identifier; an empty
    table gives an empty result; other columns pass through, whatever their names.
    """
    own_id, sha, own_sha, kept, n = free_names(docs, "__id", "__sha", "__own_sha", "kept", "n")
    verdicts = exact_dedup(docs, id_col, text_col, best).groupBy(F.col("id").alias(own_id), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias(kept), F.count("*").alias(n))
    others = materialize(verdicts.filter(~F.col(kept) | (F.col(n) > 1)), "copies")
    marked = docs.withColumn(own_sha, F.sha2(fold(F.col(text_col).cast("string")), 256))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(own_sha) == F.col(sha))
    # One plan at every size: texts are dealt by identifier, and the list of copies is hashed beside them.
    out = marked.join(others.hint("shuffle_hash"), same, "left_anti")
    repeats = others.filter(F.col(kept) & (F.col(n) > 1))
    if not repeats.isEmpty():
        out = out.unionByName(marked.join(repeats.hint("shuffle_hash"), same, "left_semi").dropDuplicates([id_col, own_sha]))
    return out.select(*docs.columns)
