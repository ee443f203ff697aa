"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomframe.llm.bytewords import FOLD, PLAIN, mix, tokens

#: Multipliers of the places in a shingle, drawn once.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; one less than ``width`` shorter than the input."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * _PLACES[k]
    return mix(total)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of folded words.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle, a text without words none.
    """
    words, _, _, bounds = tokens(texts, PLAIN, FOLD)
    windows = window_hashes(words, width)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(windows[lo : hi - width + 1])
        elif hi > lo:
            short = words[lo:hi]
            yield mix((short * _PLACES[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)
