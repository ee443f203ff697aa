"""Toxic passages as maximal-scoring segments of token log-odds.

1. One pass counts hashed words and word beginnings over all documents, and how many labelled toxic
   and clean documents hold each; log-odds with an informative Dirichlet prior
   (the corpus frequencies) give each word a score, shrunk by its uncertainty.
2. One pass finds all maximal-scoring segments of each text in linear time.
3. Segment scores become E-values (Karlin-Altschul statistics: a clean text of m
   words has K m exp(-lambda s) segments of score s or more by chance), and a
   logistic fit on the labelled sample turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.bytewords import FOLD, LETTERS, segment_ids, text_chunks, tokens
from loomframe.llm.common import id_and_text
from loomframe.llm.dense import EMITTED, add_up, emit
from loomframe.llm.labelled import held_out, training_labels
from loomframe.llm.rows import text_key
from loomframe.session import materialize

#: Word buckets; their size bounds everything that reaches the driver.
BUCKETS = 1 << 20
#: A word counts as itself and through its beginnings of these lengths in bytes, which
#: carry over to inflected and compound forms.
PREFIXES = (5, 6, 7, 8)
#: Weight of the prior against the labelled words; standard errors taken off a log-odds;
#: least signed root of the likelihood ratio (a million buckets are tested at once);
#: score of an ordinary word.
PRIOR, CAUTION, TEST, DRIFT = 0.05, 2.0, 5.0, -0.5
SEGMENTS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each token (a row for the word, one for each prefix, -1 where it has none), places, bounds."""
    hashes, starts, ends, bounds, heads = tokens(texts, LETTERS, FOLD, PREFIXES)
    rows = np.concatenate([hashes[None], heads])
    return np.where(rows > 0, rows % np.uint64(BUCKETS), BUCKETS).astype(np.int64), starts, ends, bounds


def count_words(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """(BUCKETS, 3): words of all documents, toxic and clean labelled documents that hold the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS + 1), np.int64)  # the last column takes the prefixes that tokens lack
        for batch, texts in text_chunks(batches):
            words, _, _, bounds = token_buckets(texts)
            sums[0] += np.bincount(words.ravel(), minlength=BUCKETS + 1)
            label = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            for row, value in ((1, 1), (2, 0)):
                for k in np.flatnonzero(label == value):
                    sums[row, np.unique(words[:, bounds[k] : bounds[k + 1]])] += 1
        yield emit(np.ascontiguousarray(sums[:, :BUCKETS].T))

    # The labels are at most the documented sample.
    marked = docs.join(F.broadcast(labels), "id", "left").select("text", "label")
    return add_up(marked.mapInArrow(run, EMITTED), (BUCKETS, 3), "int64")


def word_scores(counts: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bucket, and its share among the words of clean documents.

    A bucket scores its log-odds less CAUTION standard errors if a likelihood-ratio
    test over the labelled documents finds it tied to the toxic ones.
    """
    corpus, toxic, clean = counts.T.astype(np.float64)
    n1, n0 = max(toxic.sum(), 1.0), max(clean.sum(), 1.0)
    prior = 0.5 + PRIOR * (n1 + n0) * corpus / max(corpus.sum(), 1.0)
    y1, y0 = toxic + prior * n1 / (n1 + n0), clean + prior * n0 / (n1 + n0)
    odds = np.log(y1 / (y1.sum() - y1)) - np.log(y0 / (y0.sum() - y0))
    sure = odds - CAUTION * np.sqrt(1 / y1 + 1 / y0)
    holds, lacks = toxic + clean, n_toxic + n_clean - toxic - clean
    share = n_toxic / max(n_toxic + n_clean, 1)
    gain = lambda seen, of: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(of, 1e-9)), 0.0)
    ratio = 2 * (gain(toxic, holds * share) + gain(clean, holds * (1 - share)) + gain(n_toxic - toxic, lacks * share) + gain(n_clean - clean, lacks * (1 - share)))
    tied = (ratio > TEST**2) & (toxic > holds * share)
    return np.where(tied & (sure > 0), sure, DRIFT).astype(np.float32), y0 / y0.sum()


def decay_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; 1 where no score is positive."""
    if not (scores > 0).any():
        return 1.0
    s = scores.astype(np.float64)
    low, high = 1e-6, 1.0
    total = lambda r: float((share * np.exp(np.minimum(r * s, 700))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in order, in linear time.

    Only positive scores start work; between them the running sum is looked up. Each
    candidate keeps the place of the nearest one before it whose left sum is smaller.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    kept: list[tuple[int, int, float, float, int]] = []
    for k in np.flatnonzero(scores > 0).tolist():
        first, before, after = k, float(total[k]), float(total[k + 1])
        at = len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= before:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= after:
                kept.append((first, k + 1, before, after, at))
                break
            first, _, before, _, smaller = kept[at]
            del kept[at:]
            at = smaller
    return [(f, e, a - b) for f, e, b, a, _ in kept]


def find_segments(docs: DataFrame, scores: np.ndarray) -> DataFrame:
    """id, text_key, n_words, best (largest segment score), segments (bytes of the text, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(shared.value, np.float32(DRIFT))
        for batch, texts in text_chunks(batches):
            words, starts, ends, bounds = token_buckets(texts)
            own = table[words].max(axis=0) if words.size else np.zeros(0, np.float32)
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            hit = np.unique(segment_ids(bounds)[own > 0])
            for k in hit.tolist():
                lo, hi = bounds[k], bounds[k + 1]
                found[k] = [{"first": int(starts[lo + f]), "last": int(ends[lo + e - 1]), "score": s} for f, e, s in maximal_segments(own[lo:hi])]
            best = [max((x["score"] for x in f), default=0.0) for f in found]
            yield pa.record_batch([batch.column("id"), batch.column("text_key"), pa.array(np.diff(bounds), pa.int64()), pa.array(best, pa.float64()), pa.array(found, SEGMENTS)], names=["id", "text_key", "n_words", "best", "segments"])

    keyed = docs.select("id", "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "id long, text_key long, n_words long, best double, segments array<struct<first:long,last:long,score:double>>")


def _surprise(score: Column, rate: float, scale: float) -> Column:
    """-log of the E-value of a segment, not below zero."""
    return F.greatest(F.lit(0.0), F.lit(rate) * score - F.log(F.lit(scale) * F.greatest(F.col("n_words"), F.lit(1))))


#: What the probability is fitted on.
FEATURES = ("top", "rest", "amount", "size")


def features(found: DataFrame, rate: float, scale: float) -> DataFrame:
    """Surprise of the best segment and of all together, summed scores, length of the text."""
    total = lambda of: F.log1p(F.aggregate("segments", F.lit(0.0), lambda a, s: a + of(s["score"])))
    return (
        found.withColumn("top", F.least(F.lit(50.0), _surprise(F.col("best"), rate, scale)))
        .withColumn("rest", total(lambda x: _surprise(x, rate, scale)))
        .withColumn("amount", total(lambda x: x))
        .withColumn("size", F.log1p("n_words"))
    )


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-damped Newton steps; the constant comes first."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_labels: int = 40_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, n_words, segments, text_key.

    Fitted on at most ``most_labels`` labelled documents outside the held-out fold;
    word counts and the search cover all documents and whole texts. Null and empty
    texts have no words and get the lowest score. Without labels all documents get
    the same score, 0. Repeated rows get equal scores; null identifiers are scored
    and never learned from; an empty table gives an empty result; other columns are
    not read.
    """
    base = id_and_text(docs, id_col, text_col)
    sample = materialize(training_labels(labels, label_col, most_labels), "toxicity-labels")
    n_labels = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    scores, share = word_scores(count_words(base, sample), n_labels.get(1, 0), n_labels.get(0, 0))
    found = materialize(find_segments(base, scores), "toxic-segments")
    rate = decay_rate(scores, share)
    known = found.join(F.broadcast(sample), "id")
    positive = scores[scores > 0]
    least = float(np.median(positive)) if len(positive) else 1.0
    above, mass = known.filter("label = 0").agg(F.count_if(F.col("best") >= least), F.sum(F.col("n_words") * float(np.exp(-rate * least)))).first()
    scale = (above + 1) / max(mass or 0.0, 1.0)
    rows = features(known, rate, scale).select("label", *FEATURES).toPandas()  # the documented sample
    y = rows["label"].to_numpy(float)
    w = fit_logistic(rows[[*FEATURES]].to_numpy(), y) if 0 < y.sum() < len(y) else (-40.0, *[0.0] * len(FEATURES))
    logit = sum((F.col(name) * weight for name, weight in zip(FEATURES, w[1:])), F.lit(w[0]))
    score = 1 / (1 + F.exp(-logit))
    out = features(found, rate, scale).withColumn("score", score)
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "segments", "text_key")
