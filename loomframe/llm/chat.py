"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are rendered.

A log often holds a conversation several times, each snapshot a few turns longer.
Rolling hashes of turn prefixes find the snapshots that another conversation
continues; only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.session import materialize

#: Turns whose text one output row holds; longer conversations have several rows.
PART = 1024
#: How a turn is written.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, part, nth (from 1, without gaps), role, text.

    Turns are ordered by their number and then by role and text. They are numbered
    within spans of PART turn numbers, and the spans are counted up, so that a
    conversation of any length is spread over tasks.
    """
    base = turns.select(
        turns[conv_col].cast("long").alias("conv"),
        turns[turn_col].cast("long").alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    ).filter("conv is not null")
    # Turns without a number come first.
    spans = base.withColumn("span", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    sizes = spans.groupBy("conv", "span").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("span")) - F.col("n")).drop("n")
    inner = Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return spans.withColumn("k", F.row_number().over(inner)).join(before, ["conv", "span"]).select("conv", "span", (F.col("before") + F.col("k")).alias("nth"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, nth, h1, h2: 128 bits for the first ``nth`` turns of each conversation.

    Each turn's hash covers its place, so the exclusive or of all up to a turn names
    the prefix; spans are folded first, then carried over.
    """
    own = turns.select("conv", "span", "nth", F.xxhash64(F.lit(1), "nth", "role", "text").alias("x1"), F.xxhash64(F.lit(2), "nth", "role", "text").alias("x2"))
    sums = own.groupBy("conv", "span").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    outer = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "span", *(F.coalesce(F.bit_xor(f"t{k}").over(outer), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    inner = Window.partitionBy("conv", "span").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    run = own.select("conv", "span", "nth", *(F.bit_xor(f"x{k}").over(inner).alias(f"r{k}") for k in (1, 2)))
    return run.join(carried, ["conv", "span"]).select("conv", "nth", *(F.col(f"r{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"h{k}") for k in (1, 2)))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as text: conv_id, part, n_turns (of this part), n_snapshots, text.

    A conversation is dropped if all its turns are the first turns of a longer one,
    or if one with the same turns has a smaller identifier; n_snapshots counts the
    distinct conversations whose turns a kept one repeats, itself included. Turns count
    by order, not by number; null roles and texts are empty; rows without a conversation
    are left out; repeated rows are turns of their own. Texts come in parts of PART
    turn numbers. An empty table gives an empty result; other columns are not read.
    """
    numbered = materialize(numbered_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    hashes = materialize(prefix_hashes(numbered), "turn-prefixes")
    length = hashes.groupBy("conv").agg(F.max_by(F.struct("nth", "h1", "h2"), "nth").alias("last")).select("conv", "last.*")
    # Equal conversations become one; then those go whose end is the inside of another.
    distinct = materialize(length.groupBy("nth", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies")), "distinct-conversations")
    inside = hashes.join(distinct.select("conv", F.col("nth").alias("n")), "conv").filter("nth < n")
    inner = inside.select("nth", "h1", "h2").distinct()
    maximal = materialize(distinct.join(inner, ["nth", "h1", "h2"], "left_anti"), "maximal-conversations")
    # How many snapshots each kept conversation continues.
    snapshots = inside.join(distinct.select("nth", "h1", "h2", F.lit(True).alias("snapshot")), ["nth", "h1", "h2"]).groupBy("conv").agg(F.count("*").alias("inner"))
    kept = maximal.select("conv").join(snapshots, "conv", "left").select("conv", (F.coalesce("inner", F.lit(0)) + 1).alias("n_snapshots"))
    parts = numbered.join(kept, "conv").groupBy("conv", "span").agg(F.first("n_snapshots").alias("n_snapshots"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("nth", rendered(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return parts.select(F.col("conv").alias("conv_id"), F.greatest("span", F.lit(-1)).alias("part"), "n_turns", "n_snapshots", text.alias("text"))
