"""Word vectors (skip-gram, hierarchical softmax) fitted part by part, many places of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Words to either side, first and least share of the learning rate, words after which a text is cut (all as in Spark's Word2Vec).
WINDOW, RATE, LEAST_RATE, PIECE_WORDS = 5, 0.025, 1e-4, 1000
#: Words that a task holds and trains at a time, and places in them that move on together.
BLOCK_WORDS, STREAMS = 2_000_000, 256
#: Words of a part above which there are more parts, so that a task does not grow with the table.
PART_WORDS = 16_000_000


@dataclass(frozen=True)
class WordVectors:
    """A vector for each bucket of words; those below the least count have zeros."""

    buckets: int
    size: int
    vectors: np.ndarray

    def average(self, words: Column) -> Column:
        """Mean vector of an array of buckets, over all its words; zeros without words."""
        table, size = self.vectors, self.size

        @F.arrow_udf("array<double>")
        def mean(column: pa.Array) -> pa.Array:
            lengths = _lengths(column)
            text, flat = np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy()
            sums = [np.bincount(text, table[flat, i], len(lengths)) for i in range(size)]
            means = np.stack(sums, axis=1) / np.maximum(lengths, 1)[:, None]
            return pa.ListArray.from_arrays(np.arange(0, means.size + 1, size, dtype=np.int32), means.ravel())

        return mean(words)


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy()


def huffman_paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, signs, lengths) of the way from each word to the root; ``counts`` descend.

    Node i of the V - 1 inner ones is row i; a word's row is filled up with V - 1 and sign 0.
    A last row, of length 0, stands for no word.
    """
    v = len(counts)
    total, parent, sign = [int(c) for c in counts] + [0] * (v - 1), [0] * (2 * v - 1), [1] * (2 * v - 1)
    leaf, inner = v - 1, v
    for new in range(v, 2 * v - 1):
        for side in (1, -1):
            if leaf >= 0 and (inner >= new or total[leaf] < total[inner]):
                least, leaf = leaf, leaf - 1
            else:
                least, inner = inner, inner + 1
            total[new] += total[least]
            parent[least], sign[least] = new, side
    parents, sides, root = np.array(parent, np.int32), np.array(sign, np.int8), 2 * v - 2
    at, nodes, signs = np.arange(v, dtype=np.int32), [], []
    while (live := at != root).any():
        nodes.append(np.append(np.where(live, parents[at] - v, v - 1), v - 1))
        signs.append(np.append(np.where(live, sides[at], 0), 0))
        at = np.where(live, parents[at], root)
    if not nodes:
        return np.zeros((v + 1, 0), np.int32), np.zeros((v + 1, 0), np.int8), np.zeros(v + 1, np.int64)
    path = np.stack(nodes, axis=1).astype(np.int32)
    return path, np.stack(signs, axis=1).astype(np.int8), (path != v - 1).sum(axis=1)


def places_of(column: pa.Array, rank: np.ndarray, gap: int) -> np.ndarray:
    """Known words of the texts of a batch by their rank, in order; gaps as wide as the window set texts and pieces apart."""
    lengths = _lengths(column)
    known = rank[column.flatten().to_numpy()]
    text = np.repeat(np.arange(len(lengths)), lengths)[known >= 0]
    known = known[known >= 0]
    index = np.arange(len(known))
    first = np.append(True, text[1:] != text[:-1])[: len(known)]
    starts = np.flatnonzero((index - np.maximum.accumulate(np.where(first, index, 0))) % PIECE_WORDS == 0)
    return np.insert(known, np.repeat(starts, WINDOW), gap)


def train_block(places: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, paths: tuple[np.ndarray, np.ndarray, np.ndarray], rate, rng: np.random.Generator, streams: int = STREAMS) -> None:
    """One pass over the words of a block; ``vectors`` and ``nodes``, whose last rows are zeros, are changed in place.

    The block is read by ``streams`` readers, evenly spaced, that step on together: what
    their words ask of the same row is added up.  A sum is damped by a bound of its
    curvature, as single steps would slow down when they near the same goal; so rows
    that many readers meet (frequent words, the root) do not overshoot.
    ``rate`` gives the learning rate from the share of the block that is done.
    """
    path, sign, length = paths
    gap, size = len(vectors) - 1, vectors.shape[1]
    steps = -(-len(places) // streams)
    block = np.full(steps * streams + 2 * WINDOW, gap)
    block[WINDOW : WINDOW + len(places)] = places
    readers = WINDOW + steps * np.arange(streams)
    bend_vectors, bend_nodes = np.zeros(len(vectors), np.float32), np.zeros(len(nodes), np.float32)
    for step in range(steps):
        alpha = np.float32(rate(step / steps))
        reach = WINDOW - int(rng.integers(0, WINDOW))
        words = block[readers + step]
        deep = length[words].max()
        if deep == 0:
            continue
        near = block[(readers + step)[:, None] + np.concatenate((np.arange(-reach, 0), np.arange(1, reach + 1)))]
        way = np.take(path, words, axis=0)[:, :deep].astype(np.int64)
        near_vectors, way_nodes = np.take(vectors, near, axis=0), np.take(nodes, way, axis=0)
        # 2 * (wanted - sigmoid) of every node and neighbour; rows of zeros stand for what is not there
        error = way_nodes @ (near_vectors * np.float32(0.5)).transpose(0, 2, 1)
        np.tanh(error, out=error)
        np.subtract(np.take(sign, words, axis=0)[:, :deep, None], error, out=error)
        # what fills up short ways takes no part in the sums: thousands of additions to one row are slow
        there = np.flatnonzero(way.ravel() != len(nodes) - 1)
        rows = way.ravel()[there]
        to_vectors, to_nodes = error.transpose(0, 2, 1) @ way_nodes, (error @ near_vectors).reshape(-1, size)[there]
        np.add.at(bend_vectors, near.ravel(), np.repeat(np.einsum("sij,sij->s", way_nodes, way_nodes), 2 * reach))
        np.add.at(bend_nodes, rows, np.repeat(np.einsum("sij,sij->s", near_vectors, near_vectors), length[words]))
        to_vectors *= (alpha / 2 / (1 + alpha / 4 * bend_vectors[near]))[:, :, None]
        to_nodes *= (alpha / 2 / (1 + alpha / 4 * bend_nodes[rows]))[:, None]
        bend_vectors[near] = 0
        bend_nodes[rows] = 0
        _add_rows(vectors, near, to_vectors)
        _add_rows(nodes, rows, to_nodes)
        vectors[gap] = 0


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add to rows of a table, each as often as it is named; two numbers at a time where rows have an even number."""
    kind = np.float32 if table.shape[1] % 2 else np.complex64
    flat, values = table.reshape(-1).view(kind), values.reshape(-1).view(kind)
    width = len(flat) // len(table)
    np.add.at(flat, ((rows.reshape(-1, 1) * width) + np.arange(width)).ravel(), values)


def fit_vectors(texts: DataFrame, key: str, words: str, buckets: int, size: int, min_count: int, seed: int, iterations: int, parts: int) -> WordVectors:
    """Vectors of the buckets in the arrays ``words``, fitted on every text.

    As in Spark's Word2Vec, ``parts`` tasks (more on large tables) start an iteration with the
    same vectors, train them on their texts and give back those they changed, which are averaged.
    Parts, order and start follow from the rows alone, not from cores or files.
    """
    counted = texts.select(F.explode(words).alias("bucket")).groupBy("bucket").count().where(F.col("count") >= min_count)
    found = sorted(((r["count"], r["bucket"]) for r in counted.collect()), key=lambda r: (-r[0], r[1]))
    if not found:
        raise ValueError("no word is as frequent as min_count")
    counts, names = np.array([c for c, _ in found]), np.array([b for _, b in found])
    v, total = len(names), iterations * int(counts.sum()) + 1
    parts = max(parts, int(counts.sum()) // PART_WORDS)
    rank = np.full(buckets, -1, np.int32)
    rank[names] = np.arange(v)
    start = (np.random.default_rng(seed).random((v, size), np.float32) - np.float32(0.5)) / np.float32(size)
    zero = np.zeros((1, size), np.float32)
    vectors, nodes = np.concatenate((start, zero)), np.zeros((v, size), np.float32)
    dealt = texts.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key, words).select(words)

    def pass_over(iteration: int, vectors: np.ndarray, nodes: np.ndarray) -> DataFrame:
        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_vectors, own_nodes, paths = vectors.copy(), nodes.copy(), huffman_paths(counts)
            rng, done, held = np.random.default_rng([seed, iteration, TaskContext.get().partitionId()]), 0, []

            def train_held() -> int:
                places = np.concatenate(held)
                n, before = int((places < v).sum()), (total - 1) // iterations * iteration + parts * done
                train_block(places, own_vectors, own_nodes, paths, lambda share: RATE * max(1 - (before + parts * n * share) / total, LEAST_RATE), rng)
                held.clear()
                return n

            for batch in batches:
                held.append(places_of(batch.column(0), rank, v))
                if sum(map(len, held)) >= BLOCK_WORDS:
                    done += train_held()
            if held:
                train_held()
            for first, own, old in ((0, own_vectors, vectors), (v, own_nodes, nodes)):
                for at in range(0, v, 10_000):
                    rows = at + np.flatnonzero((own[at : at + 10_000] != old[at : at + 10_000]).any(axis=1))
                    ends = np.arange(0, len(rows) * size + 1, size, dtype=np.int32)
                    yield pa.record_batch({"place": pa.array(first + rows, pa.int32()), "values": pa.ListArray.from_arrays(ends, own[rows].ravel())})

        return dealt.mapInArrow(train, "place int, values array<float>")

    for iteration in range(iterations):
        changed = pass_over(iteration, vectors, nodes)
        means = changed.groupBy("place").agg(*[F.avg(F.get("values", F.lit(i))).alias(f"m{i}") for i in range(size)]).toArrow()
        place, values = means["place"].to_numpy(), np.stack([means[f"m{i}"].to_numpy() for i in range(size)], axis=1).astype(np.float32)
        vectors, nodes = vectors.copy(), nodes.copy()
        vectors[place[place < v]], nodes[place[place >= v] - v] = values[place < v], values[place >= v]
    table = np.zeros((buckets, size), np.float32)
    table[names] = vectors[:v]
    return WordVectors(buckets, size, table)
