"""Text quality from random-indexing word vectors and a two-layer network.

1. One pass over all documents adds up, for each word bucket, the sparse random
   index vectors of the words next to it; the sums are the word vectors.
2. One pass pools the vectors of each document (mean, spread, agreement of
   neighbours) together with a few shape figures.
3. A two-layer network is fitted with numpy on a bounded labelled sample, and a
   temperature fitted on a part it did not see calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.bytewords import FOLD, SPLIT, mix, segment_ids, text_chunks, tokens
from loomframe.llm.common import id_and_text
from loomframe.llm.dense import EMITTED, add_up, emit
from loomframe.llm.labelled import held_out, training_labels
from loomframe.session import materialize

#: Word buckets, dimensions, and non-zero entries of an index vector. Buckets x DIMS
#: bounds what reaches the driver and what the executors get.
BUCKETS, DIMS, ENTRIES = 1 << 14, 32, 4
#: Hidden units, passes, step, weight decay and share of the sample that fits the temperature.
HIDDEN, EPOCHS, STEP, DECAY, CALIBRATION = 32, 40, 3e-3, 1e-4, 0.2
SHAPE = 8


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's index vector."""
    draws = mix(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, ENTRIES)
    return (draws % np.uint64(DIMS)).astype(np.int64), np.where(draws >> np.uint64(63), 1.0, -1.0)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS + 1): summed index vectors of both neighbours of each word, and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums = np.zeros((BUCKETS, DIMS + 1))
        flat = np.zeros(BUCKETS * DIMS)
        for _, texts in text_chunks(batches):
            hashes, _, _, bounds = tokens(texts, SPLIT, FOLD)
            word, doc = buckets(hashes), segment_ids(bounds)
            sums[:, DIMS] += np.bincount(word, minlength=BUCKETS)
            # Equal neighbour pairs are counted once and weighted.
            pairs = (word[:-1] * BUCKETS + word[1:])[doc[:-1] == doc[1:]]
            pair, times = np.unique(pairs, return_counts=True)
            left, right = np.divmod(pair, BUCKETS)
            for to, of in ((left, right), (right, left)):
                for k in range(ENTRIES):
                    flat += np.bincount(to * DIMS + places[of, k], weights=times * signs[of, k], minlength=len(flat))
        sums[:, :DIMS] = flat.reshape(BUCKETS, DIMS)
        yield emit(sums)

    return add_up(docs.select("text").mapInArrow(run, EMITTED), (BUCKETS, DIMS + 1), "float64")


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors: mean context less the average context, zero for words never seen."""
    count = sums[:, DIMS:]
    mean = sums[:, :DIMS] / np.maximum(count, 1)
    centred = np.where(count > 0, mean - sums[:, :DIMS].sum(0) / max(count.sum(), 1), 0)
    # Rare words lean towards the average.
    centred *= count / (count + 5)
    return (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 0.05)).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of 2 * DIMS + SHAPE features for each text; zeros for texts without words."""
    hashes, starts, ends, bounds = tokens(texts, SPLIT, FOLD)
    n_texts, n = len(texts), np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros((n_texts, 2 * DIMS + SHAPE), np.float32)
    if not len(some):
        return out
    doc, word = segment_ids(bounds), buckets(hashes)
    own = vectors[word]
    at = bounds[:-1][some]
    size = n[some][:, None].astype(np.float32)
    mean = np.add.reduceat(own, at) / size
    out[some, :DIMS] = mean
    out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(own * own, at) / size - mean * mean, 0))
    inner = np.append(doc[1:] == doc[:-1], False)
    sums = lambda x: np.bincount(doc, weights=x, minlength=n_texts)
    next_ = np.minimum(np.arange(len(word)) + 1, len(word) - 1)
    agree = np.einsum("ij,ij->i", own, own[next_]) * inner
    same = (hashes == hashes[next_]) & inner
    length = (ends - starts).astype(np.float64)
    # Distinct words are counted through (text, word) keys that occur first.
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], weights=fresh, minlength=n_texts)
    total = np.maximum(n, 1)
    figures = (np.log1p(n), distinct / total, distinct / np.sqrt(total), sums(same) / total, sums(agree) / total, sums(length) / total, np.sqrt(sums(length**2) / total), np.bincount(doc, weights=length == 1, minlength=n_texts) / total)
    out[:, 2 * DIMS :] = np.column_stack(figures)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """id and x (float32 features as bytes) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, 1 << 20):
            yield pa.record_batch([batch.column("id"), pa.array([row.tobytes() for row in pool(texts, shared.value)], pa.binary())], names=["id", "x"])

    return docs.mapInArrow(run, "id long, x binary")


class Network:
    """Standardised inputs, one hidden tanh layer, a logistic output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self.standard(x)
        held = rng.random(len(y)) < CALIBRATION
        if held.all() or not held.any() or len(set(y[~held])) < 2:
            held[:] = False
        self.layers = self.fit(z[~held], y[~held], rng)
        self.temperature = 1.0
        if len(set(y[held])) == 2:
            logits = self.logits(z[held])
            grid = np.exp(np.linspace(-2, 2.5, 181))
            loss = [np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) / self.scale, -8, 8)

    def fit(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        d = z.shape[1]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        layers = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log(rate / (1 - rate))])]
        first, second, t = [0.0] * 4, [0.0] * 4, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 128):
                k = order[at : at + 128]
                hidden = np.tanh(z[k] @ layers[0] + layers[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - y[k]) / len(k)
                back = np.outer(error, layers[2]) * (1 - hidden**2)
                grads = [z[k].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], np.array([error.sum()])]
                t += 1
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    layers[j] = layers[j] - STEP * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
        return layers

    def logits(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(z @ a + b) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)) / self.temperature, -40, 40)))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labels: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (probability of label 1), predicted.

    The network is fitted on at most ``most_labels`` labelled documents outside the
    held-out fold; the word vectors and the scores cover all documents and whole
    texts. Null and empty texts have zero features and get a score like any other.
    With labels of one kind only, or none, every score is their share of ones (or
    0.5). Repeated rows get equal scores; null identifiers are scored and never
    learned from; an empty table gives an empty result; other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col)
    rows = materialize(pooled(base, word_vectors(context_sums(base))), "pooled-vectors")
    sample = training_labels(labels, label_col, most_labels)
    # The sample is bounded; its rows come in the order of the identifiers.
    known = rows.join(F.broadcast(sample), "id").toPandas().sort_values(["id", "x"])
    y = known["label"].to_numpy(float)
    if len(set(y)) < 2:
        constant = float(y.mean()) if len(y) else 0.5
        scored = rows.select("id", F.lit(constant).alias("score"))
    else:
        net = rows.sparkSession.sparkContext.broadcast(Network(np.stack([np.frombuffer(b, np.float32) for b in known["x"]]).astype(np.float64), y))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
                yield pa.record_batch([batch.column("id"), pa.array(net.value.probabilities(x.astype(np.float64)), pa.float64())], names=["id", "score"])

        scored = rows.mapInArrow(run, "id long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
