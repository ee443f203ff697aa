"""Word vectors against a plain loop, and on tables in another order."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.operators import textfeatures as T, wordvectors as W

WORDS = [f"w{i}" for i in range(60)]


def texts(n=400, width=30, seed=1):
    """Words of one half of the list stay together in a text; all words of a half are about equally frequent."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(WORDS[(i % 2) * 30 + j] for j in rng.integers(0, 30, width))) for i in range(n)]


def embedded(table, parts=4):
    model = T.word_vectors(table, "id", "text", size=4, min_count=2, parts=parts)
    return {r["id"]: r["embedding"] for r in T.embed_text(table, "id", "text", model).collect()}


def test_embedding_ignores_order_and_partitions(spark):
    rows = texts()
    a = embedded(spark.createDataFrame(rows, "id long, text string").repartition(3))
    b = embedded(spark.createDataFrame(rows[::-1], "id long, text string").repartition(7))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-5) for k in a)


def test_neighbours_get_near_vectors(spark):
    got = embedded(spark.createDataFrame(texts(4000), "id long, text string"))
    halves = [np.mean([v for k, v in got.items() if k % 2 == h], axis=0) for h in (0, 1)]
    assert np.linalg.norm(halves[0] - halves[1]) > 5 * max(np.std([v for k, v in got.items() if k % 2 == h], axis=0).max() for h in (0, 1))


def test_large_tables_have_more_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "PART_WORDS", 20_000)
    monkeypatch.setattr(W, "BLOCK_WORDS", 5_000)
    table = spark.createDataFrame(texts(4000), "id long, text string")
    model = T.word_vectors(table, "id", "text", size=4, min_count=2, iterations=2, parts=2)
    got = {r["id"]: r["embedding"] for r in T.embed_text(table, "id", "text", model).collect()}
    halves = [np.mean([v for k, v in got.items() if k % 2 == h], axis=0) for h in (0, 1)]
    assert len(got) == 4000 and np.linalg.norm(halves[0] - halves[1]) > 5 * max(np.std([v for k, v in got.items() if k % 2 == h], axis=0).max() for h in (0, 1))


def test_mean_counts_rare_words_and_null_texts(spark):
    table = spark.createDataFrame([(1, "aa aa bb bb"), (2, "aa once"), (3, None), (4, "")], "id long, text string")
    model = T.word_vectors(table, "id", "text", size=4, min_count=2, parts=2)
    place = {r["w"]: r["b"][0] for r in spark.createDataFrame([("aa",), ("bb",), ("once",)], "w string").select("w", T.hashed_words(F.col("w"), model.buckets).alias("b")).collect()}
    got = {r["id"]: r["embedding"] for r in T.embed_text(table, "id", "text", model).collect()}
    a, b = (model.vectors[place[w]].astype(float) for w in ("aa", "bb"))
    assert not model.vectors[place["once"]].any() and a.any() and b.any()
    assert got[1] == pytest.approx(list((a + b) / 2)) and got[2] == pytest.approx(list(a / 2)) and got[3] == got[4] == [0.0] * 4


def test_no_frequent_word_is_an_error(spark):
    with pytest.raises(Exception):
        T.word_vectors(spark.createDataFrame([(1, "aa bb")], "id long, text string"), "id", "text", size=4)


@pytest.mark.parametrize("counts", [[5], [5, 5], [9, 4, 3, 2, 1, 1], list(range(40, 0, -1))])
def test_paths_make_a_least_code(counts):
    path, sign, length = W.huffman_paths(np.array(counts))
    codes = ["".join("01"[int(s < 0)] for s in sign[i, : length[i]][::-1]) for i in range(len(counts))]
    assert length[-1] == 0 and (sum(2.0 ** -len(c) for c in codes) == 1.0 or len(counts) == 1)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes if a)
    merged, want = sorted(counts), 0
    while len(merged) > 1:
        two = merged[0] + merged[1]
        want, merged = want + two, sorted([two, *merged[2:]])
    assert sum(c * n for c, n in zip(counts, length)) == want


def test_gaps_part_texts_and_pieces():
    rank = np.array([0, -1, 2, 1], np.int32)
    lists = pa.array([[0, 1, 2], None, [], [3], [2] * (W.PIECE_WORDS + 1)], pa.list_(pa.int32()))
    gap = [9] * W.WINDOW
    assert W.places_of(lists, rank, 9).tolist() == [*gap, 0, 2, *gap, 1, *gap, *[2] * W.PIECE_WORDS, *gap, 2]
    assert W.places_of(lists.slice(1, 3), rank, 9).tolist() == [*gap, 1]
    assert W.places_of(lists.slice(1, 2), rank, 9).tolist() == []


@pytest.mark.parametrize("size", [4, 5])
def test_block_equals_single_steps(size):
    """Small steps hardly bend, so one pass equals the sum of steps of every pair of words."""
    rng, v, rate = np.random.default_rng(5), 12, 1e-5
    paths = W.huffman_paths(np.sort(rng.integers(1, 50, v))[::-1])
    places = rng.integers(0, v, 300)
    places[100:105] = v
    vectors, nodes = rng.normal(size=(v + 1, size)).astype(np.float32), rng.normal(size=(v, size)).astype(np.float32)
    vectors[-1] = nodes[-1] = 0
    got_vectors, got_nodes = vectors.copy(), nodes.copy()
    W.train_block(places, got_vectors, got_nodes, paths, lambda share: rate, np.random.default_rng(7), streams=8)
    reaches, steps = np.random.default_rng(7), -(-300 // 8)
    reach = [W.WINDOW - int(reaches.integers(0, W.WINDOW)) for _ in range(steps)]
    want_vectors, want_nodes = vectors.astype(float), nodes.astype(float)
    for i, word in enumerate(places):
        for j in range(max(0, i - reach[i % steps]), min(300, i + reach[i % steps] + 1)):
            if j == i or v in (word, places[j]):
                continue
            for node, sign in zip(paths[0][word][: paths[2][word]], paths[1][word]):
                a, b = vectors[places[j]].astype(float), nodes[node].astype(float)
                pull = rate * ((sign + 1) / 2 - 1 / (1 + np.exp(-a @ b)))
                want_vectors[places[j]] += pull * b
                want_nodes[node] += pull * a
    assert np.abs(want_vectors - vectors).max() > 1e-3
    assert (got_vectors - vectors) == pytest.approx(want_vectors - vectors, abs=2e-5, rel=0.05)
    assert (got_nodes - nodes) == pytest.approx(want_nodes - nodes, abs=2e-5, rel=0.05)


def test_many_equal_words_do_not_overshoot():
    """A few words fill the block, so each step adds up hundreds of pulls on the same rows."""
    paths, rng = W.huffman_paths(np.array([4, 2, 1])), np.random.default_rng(3)
    vectors, nodes = np.append(rng.random((3, 4), np.float32) - 0.5, np.zeros((1, 4), np.float32), axis=0), np.zeros((3, 4), np.float32)
    W.train_block(rng.choice(3, 200_000, p=[0.6, 0.3, 0.1]), vectors, nodes, paths, lambda share: 0.025 * (1 - share), rng)
    want = {i: np.log([0.6, 0.3, 0.1])[i] for i in range(3)}
    for near in range(3):
        for word in range(3):
            pulls = nodes[paths[0][word][: paths[2][word]]] @ vectors[near]
            assert -np.log1p(np.exp(-paths[1][word][: paths[2][word]] * pulls)).sum() == pytest.approx(want[word], abs=0.25)
