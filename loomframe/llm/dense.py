"""Sums of fixed-size arrays over all partitions of a table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blocks that an array is cut into, each summed by one task.
BLOCKS = 32


def emit(array: np.ndarray) -> pa.RecordBatch:
    """One row per block of a task's array (first axis a multiple of BLOCKS)."""
    parts = np.split(array, BLOCKS)
    return pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["block", "body"])


EMITTED = "block int, body binary"


def add_up(emitted: DataFrame, shape: tuple[int, ...], dtype: str) -> np.ndarray:
    """The sum of what all tasks emitted. Its size is fixed by ``shape``; the blocks are summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                own = np.frombuffer(zlib.decompress(body), dtype)
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "body"])

    total = np.zeros((BLOCKS, int(np.prod(shape)) // BLOCKS), dtype)
    for row in emitted.repartition(BLOCKS, "block").mapInArrow(run, EMITTED).collect():
        total[row["block"]] += np.frombuffer(zlib.decompress(row["body"]), dtype)
    return total.reshape(shape)
