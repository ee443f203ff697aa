"""Tokens, n-grams and counts over text columns, all JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

TOKEN = r"([\p{L}\p{N}_]{2,})"

# A short list of English function words; callers may pass their own.
STOP_WORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can
could did do does down during each few for from further had has have he her here hers him his how i if in into is it its
just me more most my no nor not now of off on once only or other our out over own same she should so some such than that
the their them then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your
""".split()


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain forms, derived from Unicode decompositions."""
    marked, plain = [], []
    for code in range(0x00C0, 0x0250):
        parts = unicodedata.normalize("NFKD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def strip_accents(text: Column) -> Column:
    marked, plain = accent_table()
    return F.regexp_replace(F.translate(text, marked, plain), r"\p{M}", "")


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    if stop_words:
        return F.filter(found, lambda w: ~w.isin(stop_words))
    return found


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbouring words."""
    size = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, size - 1), F.slice(words, 2, size - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(size >= 2, F.concat(words, pairs)).otherwise(words)


def bigrams_among(df: DataFrame, words: str, among: list[str]) -> DataFrame:
    """The table with ``words`` replaced by the pairs of neighbouring words that are both ``among`` the given ones."""
    size, marked = F.size(words), F.col("__marked")
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b))
    pairs = F.filter(F.zip_with(F.slice(marked, 1, size - 1), F.slice(marked, 2, size - 1), pair), lambda p: p.isNotNull())
    staged = df.withColumn("__marked", F.transform(words, lambda w: F.when(w.isin(among), w)))
    return staged.withColumn(words, F.when(size >= 2, pairs)).drop("__marked")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def count_terms(df: DataFrame, words: Column, out: str) -> DataFrame:
    """Distinct items of an array with their counts, as sorted structs (term, tf).

    Works inside the row in the time of one sort; no shuffle is needed to
    count the words of a document.  Each step is a column of its own: an
    expression used inside a lambda would be evaluated again per element.
    """
    ordered, starts = F.col("__ordered"), F.col("__starts")
    staged = df.withColumn("__ordered", F.sort_array(words))
    first = F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i))
    staged = staged.withColumn("__starts", F.filter(first, lambda i: i.isNotNull()))
    counted = F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(ordered, s).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - s).alias("tf"),
        ),
    )
    return staged.withColumn(out, counted).drop("__ordered", "__starts")
