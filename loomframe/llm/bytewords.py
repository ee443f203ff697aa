"""Tokens of many texts at once, as 64-bit hashes, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; only longer single words need more memory.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
Classes = np.ndarray | Callable[[np.ndarray], np.ndarray]
_SPACES = np.array([0x20, 9, 10, 11, 12, 13])

#: Every byte but the space and 9 to 13 belongs to a word.
PLAIN = np.ones(256, np.uint8)
PLAIN[_SPACES] = 0
#: Letters, digits and all bytes beyond ASCII make words (1), other printable bytes make symbols (2).
SPLIT = np.where([chr(b).isalnum() if b < 128 else True for b in range(256)], 1, 2).astype(np.uint8)
SPLIT[_SPACES] = 0
#: Words only.
LETTERS = np.where(SPLIT == 1, 1, 0).astype(np.uint8)
KEEP = np.arange(256, dtype=np.uint8)
FOLD = KEEP.copy()
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK_BYTES + CHUNK_BYTES // 8)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            make = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = make(_BASE), make(inverse)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hash_span(data: np.ndarray, first: np.ndarray, classes: Classes, fold: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes, starts, ends and prefix hashes of the tokens of ``data``; ``first`` marks where texts begin."""
    kind = classes(data) if callable(classes) else classes[data]
    edge = np.empty(len(data), bool)
    edge[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= first
    starts = np.flatnonzero(edge & (kind > 0))
    cuts = np.append(np.flatnonzero(edge), len(data))
    ends = cuts[np.searchsorted(cuts, starts, "right")]
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    size = ends - starts
    short = [np.where(size > k, mix((sums[np.minimum(starts + k, len(data))] - sums[starts]) * down[starts] - np.uint64(k)), np.uint64(0)) for k in prefixes]
    heads = np.array(short, np.uint64).reshape(len(prefixes), len(starts))
    return mix((sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64)), starts, ends, heads


def tokens(texts: pa.Array, classes: Classes = PLAIN, fold: np.ndarray = KEEP, prefixes: tuple[int, ...] | None = None, relative: bool = True) -> tuple[np.ndarray, ...]:
    """Tokens of a large_string array without nulls: hashes, first bytes, end bytes, bounds.

    Text ``i`` has the tokens bounds[i] to bounds[i + 1]; byte places count from the
    start of their text if ``relative``, else from that of the first text. ``classes``
    gives each byte its class (0: none), as a table or as a function of the bytes. Long inputs are cut at white space, so memory follows
    CHUNK_BYTES, not the length of a text. With ``prefixes``, a fifth array has a row
    of hashes for each of these lengths in bytes, 0 for tokens that are not longer.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = offsets[0] if len(texts) else 0
    offsets = offsets - base
    data = text_bytes(texts)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + CHUNK_BYTES)
        if to < len(data):
            back = np.flatnonzero(PLAIN[data[at:to]] == 0)
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                step = CHUNK_BYTES
                while to < len(data) and PLAIN[data[to - 1]]:
                    ahead = np.flatnonzero(PLAIN[data[to : to + step]] == 0)
                    to = to + int(ahead[0]) + 1 if len(ahead) else min(len(data), to + step)
        first = np.zeros(to - at, bool)
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        first[inside] = True
        h, s, e, heads = _hash_span(data[at:to], first, classes, fold, prefixes or ())
        parts.append((h, s + at, e + at, heads))
        at = to
    hashes, starts, ends = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
    bounds = np.searchsorted(starts, offsets, "left")
    own = np.repeat(offsets[:-1], np.diff(bounds)) if relative else 0
    if prefixes is None:
        return hashes, starts - own, ends - own, bounds
    heads = np.concatenate([p[3] for p in parts], axis=1) if parts else np.zeros((len(prefixes), 0), np.uint64)
    return hashes, starts - own, ends - own, bounds, heads


def release() -> None:
    """Give freed memory back to the system; Python workers outlive the tasks that filled them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about ``most`` bytes of text, and that text as large_string without nulls."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to
    release()


def text_bytes(texts: pa.Array) -> np.ndarray:
    """The bytes of a large_string array, one text after the other."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[texts.offset] : offsets[texts.offset + len(texts)]]


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each token, the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
