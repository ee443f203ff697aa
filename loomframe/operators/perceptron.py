"""Weights of a perceptron on large tables: L-BFGS whose gradients are summed by the tasks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block, which a task handles by one product of matrices a layer; least number of parts, and rows of one beyond that.
BLOCK_ROWS, LEAST_PARTS, PART_ROWS = 1024, 24, 50_000
#: Steps that the optimizer remembers, values it compares for convergence, conditions and trials of its line search.
MEMORY, VALUES, ARMIJO, CURVATURE, TRIALS = 10, 20, 1e-4, 0.9, 20


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of each layer, in the order in which Spark's perceptron keeps them."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(weights: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of a block under sigmoid layers and a softmax, and its gradient."""
    layers, values = _layers(weights, sizes), [x]
    for w, b in layers[:-1]:
        values.append(0.5 + 0.5 * np.tanh(0.5 * (values[-1] @ w + b)))
    scores = values[-1] @ layers[-1][0] + layers[-1][1]
    scores -= scores.max(axis=1, keepdims=True)
    row = np.arange(len(y))
    loss = np.log(np.exp(scores).sum(axis=1)).sum() - scores[row, y].sum()
    delta = np.exp(scores)
    delta /= delta.sum(axis=1, keepdims=True)
    delta[row, y] -= 1.0
    parts = []
    for (w, _), value in zip(reversed(layers), reversed(values)):
        parts += [delta.sum(axis=0), (value.T @ delta).ravel()]
        if value is not x:
            delta = (delta @ w.T) * value * (1.0 - value)
    return float(loss), np.concatenate(parts[::-1])


def minimise(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS with a line search for the strong Wolfe conditions; ends as Spark's does, by ``max_iter`` or ``tol``."""
    x, (value, grad) = start, cost(start)
    first, seen, steps = abs(value), deque([value], VALUES), deque(maxlen=MEMORY)
    for _ in range(max_iter):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        direction, scales = -grad, []
        for s, y in reversed(steps):
            scales.append(s @ direction / (s @ y))
            direction = direction - scales[-1] * y
        if steps:
            s, y = steps[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), a in zip(steps, reversed(scales)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        slope = grad @ direction
        step, low, high, best = (1.0 if steps else 1.0 / np.linalg.norm(direction)), 0.0, np.inf, None
        for _ in range(TRIALS):
            near = x + step * direction
            new, new_grad = cost(near)
            if not new <= value + ARMIJO * step * slope:
                high = step
            else:
                if best is None or new < best[1]:
                    best = near, new, new_grad
                if abs(new_grad @ direction) <= CURVATURE * abs(slope):
                    best = near, new, new_grad
                    break
                low, high = (low, step) if new_grad @ direction > 0 else (step, high)
            step = 2.0 * step if np.isinf(high) else (low + high) / 2.0
        if best is None:
            if not steps:
                break
            # what is remembered misleads: the next step follows the gradient alone
            steps.clear()
            continue
        if (best[2] - grad) @ (best[0] - x) > 0:
            steps.append((best[0] - x, best[2] - grad))
        x, value, grad = best
        seen.append(value)
        if max(seen) - value <= tol * first:
            break
    return x


def fit_weights(df: DataFrame, features: list[str], label: str, sizes: list[int], start: np.ndarray, rows: int, max_iter: int, tol: float) -> np.ndarray:
    """Weights that minimise the mean cross-entropy over all rows, from ``start``.

    Rows become blocks once, which are kept with the executors; an evaluation sends the
    weights out and returns one sum of gradients a part.  The parts follow from the
    values and the number of rows, not from the cores.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            y = batch.columns[-1].to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(y), BLOCK_ROWS):
                yield pa.record_batch({"x": pa.array([x[at : at + BLOCK_ROWS].tobytes()], pa.binary()), "y": pa.array([y[at : at + BLOCK_ROWS].tobytes()], pa.binary())})

    names = [f"f{i}" for i in range(len(features))]
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)], F.col(label).cast("double").alias("y"))
    parts = max(LEAST_PARTS, -(-rows // PART_ROWS))
    ordered = numbers.repartition(parts, F.xxhash64(*numbers.columns)).sortWithinPartitions(*numbers.columns)
    width = len(features)
    blocks = ordered.mapInArrow(pack, "x binary, y binary").persist()

    def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, total = 0, 0.0, np.zeros(len(weights))
            for batch in batches:
                for x, y in zip(*batch.columns):
                    classes = np.frombuffer(y.as_buffer(), np.int64)
                    more, grad = loss_and_gradient(weights, sizes, np.frombuffer(x.as_buffer()).reshape(-1, width), classes)
                    n, loss, total = n + len(classes), loss + more, total + grad
            yield pa.record_batch({"n": pa.array([n]), "loss": pa.array([loss]), "gradient": pa.array([total.tobytes()], pa.binary())})

        found = blocks.mapInArrow(sums, "n bigint, loss double, gradient binary").toArrow()
        n, grads = sum(found["n"].to_pylist()), [np.frombuffer(g.as_buffer()) for g in found["gradient"]]
        return sum(found["loss"].to_pylist()) / n, sum(grads) / n

    try:
        return minimise(cost, start, max_iter, tol)
    finally:
        blocks.unpersist()
