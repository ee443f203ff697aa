"""Phrase mining against a count of every phrase, whatever the sample proposes."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import phrases
from loomframe.llm.phrases import SCORE, frequent_phrases, mine_phrases
from tests.llm.helpers import LONG, document_rows, fold

DOCS = "doc_id long, text string, lang string, phrase string, size string, n string, key string, rank string, k string"


def texts():
    rng = random.Random(5)
    vocab = ["ab", "cd", "é", "日本", "new", "york", "city", "x"]
    rows = [(k, t, None if (k or 0) % 3 else "aa") for k, t in document_rows()]
    for k in range(250):
        words = [rng.choice(vocab) if rng.random() < 0.7 else f"rare{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! \t"]) for w in words)
        rows.append((k, text + rng.choice(["", "New York City hall", " the new york city"]), rng.choice(["aa", "bb", "bb", "", None])))
    # phrases that only one document in a hundred holds, and a lone long document with phrases of its own
    rows += [(7, "only here only here only here only here only here, again only here", "cc"), (None, LONG, "aa"), (None, None, None)]
    return rows


ROWS = texts()


def frame(spark, rows=ROWS, parts=4):
    return spark.createDataFrame([(*r, *["q"] * 6) for r in rows], DOCS).repartition(parts)


def plain_counts(rows, longest=4):
    counts, words = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                own = counts.setdefault((lang, k), Counter())
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, {k: n for k, n in words.items() if n}


def plain_rows(rows, least, top=2_000, covered=80):
    counts, words = plain_counts(rows)
    out = []
    for lang in words:
        of = lambda w: counts[lang, len(w)][w]
        found = [(w, n) for k in (2, 3, 4) for w, n in counts.get((lang, k), {}).items() if n >= least]
        inside = {}
        for w, n in found:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inside[w[i : i + k]] = max(inside.get(w[i : i + k], 0), n)
        scored = []
        for w, a in found:
            if 100 * inside.get(w, 0) >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (of(w[:k]) + of(w[k:])), k, of(w[:k]), of(w[k:])) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), " ".join(w), a, left, right, words[lang], score))
        out += [(lang, rank, *row[3:]) for rank, row in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,sample", [(4, 8), (30, 8), (2, 50), (9, 1)])
def test_every_frequent_phrase(spark, least, sample):
    found, passes = frequent_phrases(frame(spark), least=least, sample=sample)
    got = {(r["lang"], r["size"], r["phrase"]): r["n"] for r in found.collect()}
    counts, words = plain_counts(ROWS)
    expected = {(lang, k, " ".join(w)): n for (lang, k), own in counts.items() for w, n in own.items() if n >= least}
    assert got == expected | {(lang, 0, None): n for lang, n in words.items()}
    assert 1 <= passes <= phrases.LONGEST and (sample < 50 or passes > 1)


@pytest.mark.parametrize("least,top", [(3, 2_000), (10, 7)])
def test_ranked_rows(spark, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "RANK_ROWS", 40)
    got = mine_phrases(frame(spark), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_rows(ROWS, least, top)


def test_full_filters(spark, monkeypatch):
    """Filters that let everything through change nothing."""
    monkeypatch.setattr(phrases, "build", lambda keys, n: np.full(1 << 13, 255, np.uint8))
    got = mine_phrases(frame(spark), least=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_rows(ROWS, 5)


@pytest.mark.parametrize("size", [1, 5_000, 1 << 30])
def test_slices(monkeypatch, size):
    """The counts of slices add up, however the texts are cut into slices."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    table = pa.table({"lang": pa.array(["und" if r[2] is None else r[2] for r in ROWS]), "text": pa.array([r[1] or "" for r in ROWS])})
    got = Counter()
    for batch in phrases.count_phrases(iter(table.to_batches()), phrases._Filters([]), 4):
        for row in batch.to_pylist():
            got[row["lang"], row["size"], row["phrase"]] += row["n"]
    counts, words = plain_counts(ROWS)
    assert got == Counter({(lang, k, " ".join(w)): n for (lang, k), own in counts.items() for w, n in own.items()}) + Counter({(lang, 0, None): n for lang, n in words.items()})
    keys = Counter()
    for batch in phrases.count_keys(iter(table.to_batches()), phrases._Filters([]), 3):
        for row in batch.to_pylist():
            keys[row["key"]] += row["n"]
    assert sorted(keys.values()) == sorted(n for (_, k), own in counts.items() for n in own.values() if k <= 3)
    assert Counter(k & 3 for k in keys) == Counter({k - 1: sum(len(own) for (_, j), own in counts.items() if j == k) for k in (1, 2, 3)})


def test_empty_tables(spark):
    assert mine_phrases(frame(spark, [(1, "a", "b")]).filter("false")).collect() == []
    assert mine_phrases(frame(spark, [(1, None, None), (None, " .\n", "")])).collect() == []


def test_score_beyond_64_bits(spark):
    rows = [(a, left, right) for a in (1, 30, 10**13 - 1, 9 * 10**15) for left in (a, 3 * a + 1, 10**16) for right in (a, a + 7)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("score", F.expr(SCORE)).collect()
    assert [r["score"] for r in got] == [2_000_000 * a // (left + right) for a, left, right in rows]
