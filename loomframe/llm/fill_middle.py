"""Fill-in-middle: a text is cut in three and written with the middle last.

Cuts are found in the bytes of a text, where tokens end, or drawn in code points; a
sparse index of the multibyte characters converts between the two. It lists only
where such characters begin and how many bytes beyond one they take, so texts in
ASCII need no index at all: their code points are their bytes.

``fill_middle`` returns one row for each row of its input, ``restore`` rebuilds the
text from ``output`` and ``form`` alone.

* A null text counts as empty; the empty text, and one that already holds a mark, is ``plain``.
* A null identifier is drawn for as the empty string; rows that share one share their draws.
* Very long texts are handled in slices of some megabytes of whole texts; a single text
  longer than that is a slice of its own, and no text is ever cut.
* Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.bytewords import PLAIN, text_bytes, text_chunks

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many change their form; of a hundred of those, so many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Multibyte characters of a run of UTF-8 bytes: where each begins, and its bytes beyond one.

    ``starts`` holds byte positions, ``points`` the same places in code points, and
    ``excess[i]`` the extra bytes of the first ``i`` of them. Both lists ascend, so a
    cut is converted by one binary search and one subtraction.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.starts = np.flatnonzero(data >= 0xC0)
        lead = data[self.starts]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)])
        self.points = self.starts - self.excess[:-1]

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before the given bytes, which begin characters or end the data."""
        return cuts - self.excess[np.searchsorted(self.starts, cuts, "left")]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before the given code points."""
        return cuts + self.excess[np.searchsorted(self.points, cuts, "left")]


def _check_marks(marks: tuple[str, str, str]) -> None:
    """A mark must never arise where a text meets another mark."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed, none of them empty")
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def token_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of texts that lie one after the other, and where each text's tokens begin.

    A token is a word with the white space before it; white space that ends a text is one too.
    """
    word = PLAIN[data] > 0
    last = np.zeros(len(data) + 1, bool)
    last[bounds[1:]] = True
    # a word ends before white space or where its text ends, a text always ends its last token
    ends = np.flatnonzero(last[1:] | (word & ~np.append(word[1:], False))) + 1
    return ends, np.searchsorted(ends, bounds, "right")


def _joined(data: np.ndarray, spans: list, plain: np.ndarray) -> pa.Array:
    """For each row the given pieces of ``data`` and the fixed bytes between them, which plain rows do without."""
    rows = len(plain)
    fixed = np.frombuffer(b"".join(s for s in spans if isinstance(s, bytes)), np.uint8)
    pool = np.concatenate([data, fixed])
    first, size = np.empty((rows, len(spans)), np.int64), np.empty((rows, len(spans)), np.int64)
    at = len(data)
    for k, span in enumerate(spans):
        if isinstance(span, bytes):
            first[:, k], size[:, k] = at, np.where(plain, 0, len(span))
            at += len(span)
        else:
            first[:, k], size[:, k] = span[0], span[1] - span[0]
    size = size.ravel()
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for lo, n, to in zip(first.ravel().tolist(), size.tolist(), ends.tolist()):
        out[to - n : to] = pool[lo : lo + n]
    offsets = np.concatenate([np.zeros(1, np.int64), ends[len(spans) - 1 :: len(spans)]])
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _has_mark(texts: pa.Array, marks: tuple[str, ...]) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for mark in marks:
        found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    return found


def _draws(id_col: str, seed: int | str) -> list[Column]:
    """Four numbers below 2^32 that follow from the seed and the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = 42, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, unit: str = "token",
) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output) with ``n`` units a text.

    ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
    middle). ``unit`` says where a text may be cut: after a ``token``, or after any ``char``.
    """
    _check_marks(marks)
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    p, s, m = (mark.encode() for mark in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            data = text_bytes(texts)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            bounds = offsets - offsets[0]
            index = ExceptionIndex(data)
            h = [part.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            from_point = index.to_points(bounds)
            if unit == "token":
                ends, at = token_ends(data, bounds)
                n = np.diff(at)
                cut = lambda k: np.where(k > 0, np.append(ends, 0)[np.minimum(at[:-1] + k - 1, len(ends))], bounds[:-1])
            else:
                n = np.diff(from_point)
                cut = lambda k: index.to_bytes(from_point[:-1] + k)
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            first, second = cut(np.minimum(one, two)), cut(np.maximum(one, two))
            plain = (n == 0) | (h[2] % 100 >= rate) | _has_mark(texts, marks)
            spm = ~plain & (h[3] % 100 < suffix_first)
            # a plain text is all prefix and has no marks
            start, end = bounds[:-1], bounds[1:]
            first, second = np.where(plain, end, first), np.where(plain, end, second)
            prefix, middle, suffix = (start, first), (first, second), (second, end)
            a, b = np.flatnonzero(spm), np.flatnonzero(~spm)
            order = np.concatenate([a, b])
            of = lambda span, rows: (span[0][rows], span[1][rows])
            outputs = [
                _joined(data, [s, of(suffix, a), p, of(prefix, a), m, of(middle, a)], plain[a]),
                _joined(data, [p, of(prefix, b), s, of(suffix, b), m, of(middle, b)], plain[b]),
            ]
            points = lambda span: pa.array((index.to_points(span[1]) - index.to_points(span[0]))[order], mask=plain[order])
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))[order]
            yield pa.record_batch(
                [part.column("id").take(pa.array(order)), pa.array(n[order]), pa.array(form.tolist(), pa.string()), points(prefix), points(middle), pa.concat_arrays(outputs).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *_draws(id_col, seed))
    return rows.mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_middle`` was given, from its output and form."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
