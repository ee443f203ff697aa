"""TF-IDF, length, sentiment and embedding features of text columns."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.functions import text as X
from loomframe.functions.ordering import order_index
from loomframe.operators.wordvectors import WordVectors, fit_vectors
from loomframe.session import materialize, spread


# terms of a bounded vocabulary that share a slot of its lookup, on average
SLOT_TERMS = 4
# words that an expression names; more are looked up or counted without
LISTED = 5_000


@dataclass(frozen=True)
class Vocabulary:
    """At most ``max_features`` terms in alphabetical order with their idf."""

    terms: list[str]
    idf: list[float]
    bigrams: bool
    plain: bool
    stop_words: list[str]

    def slots(self) -> tuple[Column, int]:
        """The terms by a hash, as one constant: arrays of (term, place, idf)."""
        n = max(1, len(self.terms) // SLOT_TERMS)
        table: list[list[dict]] = [[] for _ in range(n)]
        for i, (term, idf) in enumerate(zip(self.terms, self.idf)):
            table[zlib.crc32(term.encode()) % n].append({"t": term, "i": i, "v": idf})
        return F.from_json(F.lit(json.dumps(table)), "array<array<struct<t:string,i:bigint,v:double>>>"), n

    def known_terms(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """(term, tf, feature, idf) of the vocabulary's terms in each text; a term is looked up once a text."""
        table, n = self.slots()
        found = analyse(df, text, self.bigrams, self.plain, self.stop_words)
        if len(self.terms) <= LISTED:
            found = found.withColumn("__terms", F.filter("__terms", lambda w: w.isin(self.terms)))
        counted = X.count_terms(found, F.col("__terms"), "__all").drop("__terms")

        def look_up(s: Column) -> Column:
            slot = F.get(table, F.pmod(F.crc32(s["term"]), F.lit(n)).cast("int"))
            return F.struct(s["term"].alias("term"), s["tf"].alias("tf"), F.get(F.filter(slot, lambda x: x["t"] == s["term"]), F.lit(0)).alias("hit"))

        hits = counted.withColumn("__hits", F.filter(F.transform("__all", look_up), lambda s: s["hit"].isNotNull())).drop("__all")
        flat = F.transform("__hits", lambda s: F.struct(s["term"].alias("term"), s["tf"].alias("tf"), s["hit"]["i"].alias("feature"), s["hit"]["v"].alias("idf")))
        return hits.withColumn(out, flat).drop("__hits")


@dataclass(frozen=True)
class TermTable:
    """A vocabulary without a bound: (term, feature, idf) as a table, which texts are joined with."""

    rows: DataFrame
    bigrams: bool
    plain: bool
    stop_words: list[str]


def analyse(df: DataFrame, text: Column, bigrams: bool, plain: bool, stop_words: list[str] | None) -> DataFrame:
    """The table with the terms of a text in ``__terms``."""
    words = X.tokens(X.strip_accents(text) if plain else text, stop_words)
    found = df.withColumn("__terms", words)
    return found.withColumn("__terms", X.with_bigrams(F.col("__terms"))) if bigrams else found


def fit_tfidf(
    df: DataFrame,
    texts: list[Column],
    max_features: int | None = None,
    min_df: int = 2,
    max_df: float = 1.0,
    bigrams: bool = False,
    plain: bool = False,
    stop_words: list[str] | None = None,
) -> Vocabulary | TermTable:
    """Vocabulary of a corpus made of all given text columns, stacked.

    With ``max_features`` it is a bounded list; without, a table, and nothing is collected.

    Terms are flagged where they first occur in a document, so one pass with
    map-side counts gives both corpus and document frequency; the shuffle
    holds one row per term and task, not one per (document, term).  A pair of
    words is no more frequent than either of them, so with ``max_features``
    only pairs of words that reach the last place among the words are counted.
    """
    stop_words = X.STOP_WORDS if stop_words is None else stop_words

    def terms_of(bigrams: bool) -> DataFrame:
        parts = [analyse(spread(df.select(t.alias("__text"))), F.col("__text"), bigrams, plain, stop_words).select("__terms") for t in texts]
        return reduce(DataFrame.unionAll, parts)

    n_docs = df.count() * len(texts)
    in_range = (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)
    counted = None
    if bigrams and max_features:
        words = materialize(_counts(terms_of(False)), "word-counts")
        last = words.where(in_range).orderBy(F.desc("total"), "term").limit(max_features).agg(F.min("total").alias("total"), F.count("*").alias("n")).first()
        if last["n"] == max_features:
            among = [r["term"] for r in words.where(F.col("total") >= last["total"]).select("term").limit(LISTED + 1).collect()]
            if len(among) <= LISTED:
                counted = words.unionByName(_counts(X.bigrams_among(terms_of(False), "__terms", among)))
    counted = (_counts(terms_of(bigrams)) if counted is None else counted).where(in_range)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    if max_features is None:
        terms = materialize(counted.select("term", idf.alias("idf")), "terms")
        numbered = order_index(terms, "term", "feature").withColumnRenamed("value", "term")
        return TermTable(materialize(terms.join(numbered, "term").select("term", "feature", "idf"), "term-table"), bigrams, plain, list(stop_words))
    top = counted.orderBy(F.desc("total"), "term").limit(max_features)
    rows = sorted((r["term"], r["idf"]) for r in top.select("term", idf.alias("idf")).collect())
    return Vocabulary([t for t, _ in rows], [i for _, i in rows], bigrams, plain, list(stop_words))


def _counts(corpus: DataFrame) -> DataFrame:
    """(term, total, df) of a table of ``__terms``."""
    rows = X.count_terms(corpus, F.col("__terms"), "__counts").select(F.inline_outer("__counts")).where(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def apply_tfidf(df: DataFrame, key: str, text: Column, vocabulary: Vocabulary | TermTable) -> DataFrame:
    """Long (key, feature, term, weight) rows, unit length per document.

    With a bounded vocabulary counting, weighting and the norm all happen inside the
    row; with a table of terms the counts are joined with it.
    """
    shown = [key, F.col("feature").cast("bigint").alias("feature"), "term", (F.col("w") / F.col("__norm")).alias("weight")]
    texts = spread(df.select(key, text.alias("__text")))
    if isinstance(vocabulary, TermTable):
        found = analyse(texts, F.col("__text"), vocabulary.bigrams, vocabulary.plain, vocabulary.stop_words)
        counts = X.count_terms(found, F.col("__terms"), "__counts").select(key, F.inline_outer("__counts")).where(F.col("term").isNotNull())
        weighted = counts.join(vocabulary.rows, "term").withColumn("w", F.col("tf") * F.col("idf"))
        return weighted.withColumn("__norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(*shown)
    known = vocabulary.known_terms(texts, F.col("__text"), "__counts")
    weighted = F.transform("__counts", lambda s: F.struct(s["term"].alias("term"), s["feature"].alias("feature"), (s["tf"] * s["idf"]).alias("w")))
    # inline_outer: a plain inline adds a size filter that the optimizer pushes
    # down through the staged columns, undoing the staging
    rows = known.select(F.col(key), weighted.alias("ws"))
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, s: a + s["w"] * s["w"]))
    return rows.select(key, norm.alias("__norm"), F.inline_outer("ws")).where(F.col("term").isNotNull()).select(*shown)


def tfidf_columns(df: DataFrame, key: str, text: Column, vocabulary: Vocabulary, prefix: str) -> DataFrame:
    """One column per term, for model input; built from the row, no pivot."""
    if isinstance(vocabulary, TermTable):
        raise ValueError("columns need a bounded vocabulary; name max_features")
    pairs = F.transform("__counts", lambda s: F.struct(s["feature"], s["tf"]))
    named = vocabulary.known_terms(df, text, "__counts").withColumn("__tf", F.map_from_entries(pairs))
    raw = [F.coalesce(F.element_at("__tf", F.lit(i).cast("bigint")), F.lit(0)) * F.lit(v) for i, v in enumerate(vocabulary.idf)]
    named = named.withColumn("__w", F.array(*raw)).withColumn("__n", F.sqrt(F.aggregate("__w", F.lit(0.0), lambda a, w: a + w * w)))
    unit = {f"{prefix}{i}": F.when(F.col("__n") > 0, F.get("__w", F.lit(i)) / F.col("__n")).otherwise(0.0) for i in range(len(raw))}
    return named.withColumns(unit).drop("__counts", "__tf", "__w", "__n")


def length_features(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    text = F.coalesce(F.col(column), F.lit(""))
    chars, words = F.char_length(text), X.word_count(text)
    return df.withColumns(
        {
            f"{prefix}char_count": chars,
            f"{prefix}word_count": words,
            f"{prefix}sentence_count": F.regexp_count(text, F.lit(r"[.!?]+")),
            f"{prefix}avg_word_length": words / F.greatest(chars, F.lit(1)),
        }
    )


def sentiment(df: DataFrame, key: str, text: str, lexicon: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each text.

    ``lexicon`` is a small caller-supplied word list; it is turned into a
    literal map, so the work is one projection over the table.
    """
    words = list(lexicon)
    known = F.filter(X.tokens(F.col(text)), lambda w: w.isin(words))
    table = F.create_map(
        *[x for w, (p, s) in lexicon.items() for x in (F.lit(w), F.struct(F.lit(float(p)).alias("p"), F.lit(float(s)).alias("s")))]
    )
    hits = F.transform(known, lambda w: F.element_at(table, w))
    count = F.size("__hits")

    def mean(field: str) -> Column:
        total = F.aggregate("__hits", F.lit(0.0), lambda a, h: a + h[field])
        return F.when(count > 0, total / count).otherwise(0.0)

    scored = df.withColumn("__hits", hits)
    return scored.select(key, mean("p").alias("polarity"), mean("s").alias("subjectivity"))


def hashed_words(text: Column, buckets: int) -> Column:
    """Every word of a text as the number of its hash bucket; none is left out."""
    return F.transform(X.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def word_vectors(df: DataFrame, key: str, text: str, size: int = 16, min_count: int = 5, seed: int = 42, iterations: int = 1, buckets: int = 1 << 18, parts: int = 16) -> WordVectors:
    """Fit word vectors; the model averages them over each document.

    The vectors live on the driver between iterations, so words share
    ``buckets`` hash buckets: a table of fixed size for any vocabulary.  Documents
    are dealt by a hash of their key into ``parts`` ordered parts, on any number of
    cores; words of equal count are ordered by their buckets.
    """
    words = spread(df.select(key, text)).select(F.col(key).alias("key"), hashed_words(F.col(text), buckets).alias("words"))
    return fit_vectors(materialize(words, "hashed-words"), "key", "words", buckets, size, min_count, seed, iterations, parts)


def embed_text(df: DataFrame, key: str, text: str, model: WordVectors) -> DataFrame:
    return spread(df.select(key, text)).select(key, model.average(hashed_words(F.col(text), model.buckets)).alias("embedding"))


def embedding_columns(df: DataFrame, key: str, column: str, width: int, max_features: int | None = None) -> DataFrame:
    """Vector entries as columns ``{column}_embed_i``, at most ``max_features`` if given."""
    count = width if max_features is None else min(width, max_features)
    return df.select(key, *[F.get(F.col(column), F.lit(i)).cast("double").alias(f"{column}_embed_{i}") for i in range(count)])
