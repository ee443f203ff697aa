"""Fill-in-middle against a plain version over code points, over every odd case."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm.fill_middle import ExceptionIndex, fill_middle, restore
from tests.llm.helpers import DOCS, document_rows, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = document_rows() + [
    (300, "a <P> mark"), (301, "<M>"), (302, "  leading and trailing \n"), (303, "\U0001f600 é日 x\U0001f600"), (304, "<"), (305, "ends with <P"), (306, " "),
    *[(400 + k, f"é{k} <S <M  日本 \U0001f600\U0001f600 ascii tail <") for k in range(60)],
]


def plain_row(k, text, unit="token", marks=("<P>", "<S>", "<M>"), rate=50, share=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()
    h = [int(digest[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return (k, n, "plain", None, None, text)
    if h[3] % 100 < share:
        return (k, n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid)
    return (k, n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


def sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("unit", ["token", "char"])
@pytest.mark.parametrize("rate", [50, 100])
def test_rows_and_round_trip(spark, unit, rate):
    got = fill_middle(documents(spark, ROWS), unit=unit, rate=rate).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert sort([tuple(r)[:6] for r in got]) == sort([plain_row(k, t, unit, rate=rate) for k, t in ROWS])
    texts = sorted(t or "" for _, t in ROWS)
    assert sorted(r["back"] for r in got) == texts
    assert rate < 100 or {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_marks(spark):
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    got = fill_middle(documents(spark, ROWS), marks=marks, rate=100, suffix_first=20).withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert sort([tuple(r)[:6] for r in got]) == sort([plain_row(k, t, marks=marks, rate=100, share=20) for k, t in ROWS])
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in ROWS)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "<PP>x<P>", "<M>"), ("aba", "<S>", "<M>"), ("xy", "yz", "<M>")])
def test_marks_that_could_arise_anew(spark, marks):
    with pytest.raises(ValueError):
        fill_middle(documents(spark, ROWS[:2]), marks=marks)


def test_empty_table(spark):
    assert fill_middle(spark.createDataFrame([], DOCS)).collect() == []


def test_index_holds_only_exceptions():
    text = "plain é日\U0001f600 x" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    index = ExceptionIndex(data)
    assert len(index.starts) == 9 and index.excess.tolist()[:4] == [0, 1, 3, 6]
    cuts = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.to_points(cuts).tolist() == list(range(len(text) + 1))
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == cuts.tolist()
    assert len(ExceptionIndex(np.frombuffer(b"ascii only", np.uint8)).starts) == 0
