"""Vectors, conversations, classifiers and the pipeline."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomframe.llm import chat, vectors
from loomframe.llm.chat import format_chats
from loomframe.llm.components import components
from loomframe.llm.membership import build, perhaps
from loomframe.llm.quality import Network, score_quality
from loomframe.llm.toxicity import maximal_segments, score_toxicity
from loomframe.llm.vectors import near_vectors
from tests.llm.helpers import document_rows, documents, fold, labels, smallest, words

# Vectors


def vector_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[3] + 0.05 * rng.normal(size=8)).tolist()) for k in range(40)]
    rows += [(200, base[3].tolist()), (201, (1e200 * base[3]).tolist()), (202, (1e-200 * base[3]).tolist()), (203, (-base[3]).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [float("inf")] + [1.0] * 7), (306, [1.0, 2.0])]
    return rows


def plain_vectors(rows, least=0.9):
    usable = {k: np.array(v) / np.abs(v).max() for k, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in usable.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= least]
    count = Counter(k for pair in links for k in pair)
    root = smallest(links, [k for k, _ in rows])
    return {k: (count[k], root[k], root[k] == k) for k, _ in rows}


@pytest.mark.parametrize("per_shard, block", [(1_000, 20_000), (20, 9)])
def test_near_vectors(spark, monkeypatch, per_shard, block):
    monkeypatch.setattr(vectors, "PER_SHARD", per_shard)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    table = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, id string, unit int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table).collect()}
    assert got == plain_vectors(rows)


def links_of_every_length(rows, least=0.9):
    """n_links, component and kept of finite vectors, each compared with all of its length."""
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    count = Counter(k for pair in links for k in pair)
    root = smallest(links, list(unit))
    return {k: (count[k], root[k], root[k] == k) for k in unit}


@pytest.mark.parametrize("per_shard", [1_000, 20])
def test_near_vectors_of_several_lengths(spark, monkeypatch, per_shard):
    monkeypatch.setattr(vectors, "PER_SHARD", per_shard)
    rng = np.random.default_rng(5)
    rows = []
    for first, width, n in ((0, 8, 60), (1000, 5, 50), (2000, 3, 1), (3000, 2, 2)):
        base = rng.normal(size=(n, width))
        rows += [(first + k, v.tolist()) for k, v in enumerate(base)]
        rows += [(first + 500 + k, (base[0] + 0.02 * rng.normal(size=width)).tolist()) for k in range(7)]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    want = links_of_every_length(rows)
    assert got == want and want[1500][0] >= 7 and want[2500][0] >= 7


def test_near_vectors_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, base[0].tolist()) for k in range(300)]
    rows += [(2000 + k, (base[1] + 0.01 * rng.normal(size=6)).tolist()) for k in range(60)]
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    monkeypatch.setattr(vectors, "HOT", 100)
    members, spread = [], vectors._spread
    monkeypatch.setattr(vectors, "_spread", lambda *args: members.append(spread(*args)) or members[-1])
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert got == links_of_every_length(rows)
    # 400 vectors, 100 distinct; no task holds a whole shard or a copy.
    assert all(m.select("id").distinct().count() == 100 for m in members)
    assert max(r["count"] for m in members for r in m.groupBy("shard", "low", "high").count().collect()) < 80


def test_search_goes_on_until_the_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_SHARD", 10)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 4))
    rows = [(k, (base[k % 20] + 0.3 * rng.normal(size=4)).tolist()) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table, overlap=1, recall=1.0, tries=1).collect()}
    assert got == links_of_every_length(rows)


def test_graphs_find_the_links_without_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_SHARD", 100)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 12))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, (base[k % 90] + 0.08 * rng.normal(size=12)).tolist()) for k in range(600)]
    beams, search = [], vectors.search_shards
    monkeypatch.setattr(vectors, "search_shards", lambda *args: beams.append(args[3]) or search(*args))
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    want = links_of_every_length(rows)
    assert beams and None not in beams  # the search by graphs was enough
    shares = [min(1, got[k][0] / n) for k, (n, _, _) in want.items() if n]
    assert sum(shares) / len(shares) >= 0.99
    assert all(got[k][0] <= n for k, (n, _, _) in want.items())


def test_clean_tables_are_not_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_SHARD", 50)
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 32)))], "vec_id long, embedding array<double>")
    beams, search = [], vectors.search_shards
    monkeypatch.setattr(vectors, "search_shards", lambda *args: beams.append(args[3]) or search(*args))
    assert {r["n_links"] for r in near_vectors(table).collect()} == {0}
    assert beams == [32]


def unit_rows(seed, n, width):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pruned_neighbours_point_in_different_directions():
    x = unit_rows(10, 400, 6).astype(np.float32)
    graph = vectors.pruned_graph(x)
    assert graph.shape == (400, vectors.DEGREE) and (graph != np.arange(400)[:, None]).all()
    for k in range(0, 400, 37):
        near = [j for j in graph[k] if j >= 0]
        far = {j: 2 - 2 * float(x[k] @ x[j]) for j in near}
        assert near and near[0] == min((j for j in range(400) if j != k), key=lambda j: 2 - 2 * float(x[k] @ x[j]))
        assert len(set(near)) == len(near) and k not in near
        for i, j in enumerate(near):
            # No neighbour is reached through one picked before it.
            assert all(vectors.SLACK * (2 - 2 * float(x[i2] @ x[j])) > far[j] - 1e-4 for i2 in near[:i])
    assert (vectors.pruned_graph(x[:1]) == -1).all()


def test_range_search_from_the_medoid_scores_few_nodes():
    centre = unit_rows(11, 60, 8)
    x = centre[np.arange(3000) % 60] + 0.1 * unit_rows(12, 3000, 8)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x32, ids = x.astype(np.float32), np.arange(3000)
    graph = vectors.Graph(x32, ids, [row[row >= 0] for row in vectors.pruned_graph(x32)])
    queries = x32[::100]
    near = vectors.range_search(graph, queries, np.full(len(queries), -1), 0.97, 48)
    true = queries @ x32.T >= 0.97
    assert (near & true).sum() >= 0.95 * true.sum()
    # Parts that no list connects are entered by their own medoids.
    apart = vectors.Graph(x32, ids, [np.array([(k + 60) % 3000]) for k in range(3000)])
    assert sorted(apart.medoids % 60) == list(range(60))
    assert (vectors.range_search(apart, queries, np.full(len(queries), -1), 0.97, 48) & true).sum() >= 0.95 * true.sum()
    # A list may name members of other shards only; then it is as good as empty.
    lone = vectors.Graph(x32[:3], ids[:3], [np.array([77]), np.zeros(0, np.int64), np.array([2, 500])])
    assert lone.ends.tolist() == [0, 0, 0, 0]


def test_audit_is_an_average_over_vectors(spark):
    truth = spark.createDataFrame([(0, 1000)] + [(k, 1) for k in range(1, 10)], "id long, true long")
    found = spark.createDataFrame([(0, 1000)], "id long, links long")
    assert vectors.audit(truth, found) == pytest.approx(0.1)


def test_vectors_without_any(spark):
    kinds = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], kinds)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], kinds)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (2, 0, 2)]
    twice = near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0])], kinds)).collect()
    assert Counter((r["id"], r["n_links"], r["component_id"]) for r in twice) == Counter({(1, 1, 1): 2, (2, 1, 1): 1, (None, 0, None): 1})


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest([p for p in links if p[0] != p[1]], {n for p in links if p[0] != p[1] for n in p})
    assert got == want


def test_membership_has_no_misses(spark):
    keys = spark.range(0, 3000, 3)
    bits = build(keys, 1000)
    assert perhaps(bits, np.arange(0, 3000, 3)).all()
    assert perhaps(bits, np.arange(10**6, 10**6 + 10_000)).mean() < 0.05
    assert not perhaps(build(keys.limit(0), 0), np.arange(100)).any()


# Conversations


def conversation_rows():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), ("user", ""), (None, "odd")]
    rows = []
    for conv, turns in {1: talk[:2], 2: talk[:4], 3: talk, 4: talk[:4], 5: [("user", "hi"), ("assistant", "other")], 6: talk[:1], 7: talk[1:3], 8: [("user", "hi")] * 3}.items():
        rows += [(conv, 10 * k + conv % 3, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(9, 0, "user", "b"), (9, 0, "user", "a"), (9, None, "system", "first"), (9, 0, "user", "a"), (None, 0, "user", "x"), (10, -7, "user", "minus")]
    return rows + [(11, k, "user", f"turn {k}") for k in range(50)] + [(12, k, "user", f"turn {k}") for k in range(33)]


def plain_chats(rows, part):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    full = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}
    spans = {c: [-1 if not known else max(-1, turn // part) for known, turn, _, _ in sorted(ts)] for c, ts in turns.items()}
    firsts = {}
    for c in sorted(full):
        firsts.setdefault(tuple(full[c]), c)
    heads = {s[:k] for s in firsts for k in range(1, len(s))}
    out = {}
    for s, c in firsts.items():
        if s in heads:
            continue
        n = 1 + sum(s[:k] in firsts for k in range(1, len(s)))
        for span in dict.fromkeys(spans[c]):
            own = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for (r, t), at in zip(s, spans[c]) if at == span]
            out[(c, span)] = (len(own), n, "".join(own))
    return out


@pytest.mark.parametrize("part", [4, 1024])
def test_format_chats(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, conv int, span string").repartition(4)
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["n_snapshots"], r["text"]) for r in format_chats(table).collect()}
    assert got == plain_chats(rows, part)
    assert format_chats(table.limit(0)).count() == 0


# Classifiers


def labelled_corpus(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(900):
        plain = [rng.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(rng.randint(0, 20)) for _ in range(rng.randint(20, 60))]
        toxic, junk = k % 9 == 0, k % 7 == 0
        if toxic:
            plain[5:5] = rng.choices(["vilest", "nastiest", "rotten"], k=4)
        if junk:
            plain = [w + "$$$" for w in plain]
        rows.append((k, " ".join(plain)))
        marks.append((k, int(not junk), int(toxic)))
    odd = [(10_000, None), (10_001, ""), (10_002, "word " * 50_000), (None, "vilest rotten vilest"), (5, rows[5][1])]
    return documents(spark, rows + odd), labels(spark, [*marks, (None, 1, 1), (7, None, None), (8, 1, 0)]), marks, len(rows) + len(odd)


def test_classifiers(spark):
    docs, marked, marks, n = labelled_corpus(spark)
    for score, column in ((score_quality, 1), (score_toxicity, 2)):
        got = score(docs, marked).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
        limit = 0.5 if column == 1 else 0.7
        assert all(r["predicted"] == int(r["score"] >= limit) for r in got)
        assert all(r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
        verdict = {r["id"]: r["predicted"] for r in got}
        held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 3 == 1]
        assert np.mean([verdict[m[0]] == m[column] for m in held]) > 0.95
        # Nothing but the text and the labels of the learning part may count.
        flipped = labels(spark, [m if m not in held else (m[0], 1 - m[1], 1 - m[2]) for m in marks])
        again = {(r["id"], r["score"]) for r in score(docs, flipped).collect()}
        assert again == {(r["id"], r["score"]) for r in score(docs, labels(spark, marks)).collect()}
    toxic = [r for r in got if r["id"] == 0][0]
    text = next(r["text"] for r in docs.filter("doc_id = 0").collect())
    assert any("rotten" in p or "vilest" in p or "nastiest" in p for p in (text.encode()[s["first"] : s["last"]].decode() for s in toxic["segments"]))


def test_classifiers_without_labels_or_rows(spark):
    docs, marked, _, n = labelled_corpus(spark)
    for score in (score_quality, score_toxicity):
        assert score(docs, marked.limit(0)).count() == n
        assert score(docs.limit(0), marked).count() == 0


def test_maximal_segments():
    assert maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert maximal_segments(np.array([-1.0, -2])) == maximal_segments(np.zeros(0)) == []
    assert [s[:2] for s in maximal_segments(np.array([2.0, -1, 2, -9, 3]))] == [(0, 3), (4, 5)]


def test_maximal_segments_of_a_long_declining_text():
    scores = np.full(400_000, -0.5)
    scores[::4] = 1.0  # each start lies below all before it
    at = time.process_time()
    assert maximal_segments(scores) == [(k, k + 1, 1.0) for k in range(0, 400_000, 4)]
    assert time.process_time() - at < 30  # a walk to the front takes 5e9 steps


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = Network(x, y).probabilities(x)
    for low in (0.1, 0.4, 0.7):
        at = (p >= low) & (p < low + 0.2)
        assert abs(p[at].mean() - y[at].mean()) < 0.08


# Pipeline


def test_pipeline(spark, sf, tmp_path):
    docs, marked, marks, _ = labelled_corpus(spark)
    extra = [(k + 5000, t) for k, t in document_rows() if k is not None]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + extra
    sf_dir = f"file://{tmp_path}/tables"
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf_dir}/documents.parquet")
    marked.write.parquet(f"{sf_dir}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    steps, now = [rows], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if k < 4:
            assert out.columns == now.columns, name
        out.write.parquet(f"{sf_dir}/stage{k}")
        now = spark.read.parquet(f"{sf_dir}/stage{k}")
        steps.append(now.collect())
    ids = [Counter(r[0] for r in step) for step in steps]
    toxic = {m[0] for m in marks if m[2]}
    assert len(toxic - set(ids[1])) > 0.9 * len(toxic) and not set(ids[0]) - set(ids[1]) - toxic - {None}
    texts = Counter(fold(r[1]) for r in steps[2])
    assert max(texts.values()) == 1 and set(texts) == {fold(r[1]) for r in steps[1]}
    gone = set(ids[2]) - set(ids[3])
    assert gone and all(len(words(dict((r[0], r[1]) for r in steps[2])[k])) > 0 for k in gone)
    assert ids[4] == ids[3] and "password=abcdefgh1" not in " ".join(r[1] or "" for r in steps[4])
    assert Counter(r["doc_id"] for r in steps[5] if r["piece"] == 0) == ids[4]
    assert corpus_pipeline.run(spark, sf_dir).count() == len(steps[5])
