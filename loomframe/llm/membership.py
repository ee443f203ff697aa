"""Membership filters: bit sets of a fixed size that say "surely not" or "perhaps".

They spare a shuffle of texts: rows that surely match no key need no join. Rows
that perhaps do are joined exactly, so results never depend on the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomframe.llm.bytewords import mix

#: The size follows the number of keys, 16 bits each, between these bounds (8 KB and
#: 64 MB); beyond some fifty million keys the filter spares less and less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
BLOCKS = 16


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def build(keys: DataFrame, n_keys: int) -> np.ndarray:
    """Bit set (bytes) of the one long column of ``keys``; parts are merged on the executors."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n_keys).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(size // 8, np.uint8), False
        for batch in batches:
            some = some or batch.num_rows > 0
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), size):
                at = np.unique(at)
                head = np.flatnonzero(np.append(True, at[1:] >> 3 != at[:-1] >> 3)[: len(at)])
                bits[at[head] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), head) if len(at) else np.zeros(0, np.uint8)
        if some:
            yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(bits, BLOCKS)], pa.binary())], names=["block", "body"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                own = np.frombuffer(zlib.decompress(body), np.uint8)
                sets[block] = sets[block] | own if block in sets else own
        if sets:
            yield pa.record_batch([pa.array(list(sets), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sets.values()], pa.binary())], names=["block", "body"])

    schema = "block int, body binary"
    out = np.zeros((BLOCKS, size // 8 // BLOCKS), np.uint8)
    for row in keys.mapInArrow(part, schema).repartition(BLOCKS, "block").mapInArrow(merge, schema).collect():
        out[row["block"]] |= np.frombuffer(zlib.decompress(row["body"]), np.uint8)
    return out.reshape(-1)


def perhaps(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the set."""
    found = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(bits)):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return found
