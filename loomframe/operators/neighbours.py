"""Exact nearest-neighbour join, k-NN models and the local outlier factor.

The join never forms all pairs of rows.  Points lie in the leaves of a tree of
pivots whose depth follows their number.  A query first searches the leaf it
descends to; its k-th distance there and the triangle inequality tell which
other leaves it has to visit.  Leaves are cut into blocks of bounded size on
both sides, a block keeps only its k best per query, and a last per-query
top-k merges the blocks.  Equal vectors are searched once, so a large group
of copies costs as much as one row.

Wide vectors lie nearly all equally far from each other, so bounds rule out
few leaves and every query would be sent to every block.  There packets of
vectors are written once; a task reads some packets of queries and one part of
the packets of points, and only the k best of each query leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomframe.functions.quantiles import exact_quantiles
from loomframe.session import materialize

DIGITS = 9
BLOCK_POINTS = 2_048
BLOCK_QUERIES = 4_096
# from so many dimensions on bounds prune little and a pair is cheap: blocks of both sides are larger
WIDE = 16
WIDE_BLOCK = 8_192
# from so many dimensions on a matrix product rules pairs out before distances are taken
PRODUCT_WIDTH = 8
# children of a node of the pivot tree
FAN = 256
# distances are rounded, bounds are not
SLACK = 1e-8
# wide vectors go down the tree if a query visits fewer of the root's children, and fewer than half, on the average of so many queries
VISITS = 4
ASKED = 256
# vectors of a packet, and of the part of the points that a task reads
PACKET_BYTES = 1 << 20
PART_BYTES = 1 << 27
# points of a packet that give a query its first bound, and the sides of a product
FIRST = 1_024
TILE = (512, 2_048)


def _distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distance matrix from explicit differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = np.abs(a[start : start + step, None, :] - b[None, :, :])
        if metric == "manhattan":
            out[start : start + step] = gap.sum(axis=2)
        elif metric == "minkowski":
            out[start : start + step] = (gap**p).sum(axis=2) ** (1.0 / p)
        else:
            out[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` from the same row of ``b``, a few at a time."""
    out, step = np.empty(len(a)), max(1, 1_000_000 // a.shape[1])
    for start in range(0, len(a), step):
        gap = np.abs(a[start : start + step] - b[start : start + step])
        out[start : start + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _apart(a: np.ndarray, q: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of the rows ``q`` of ``a`` from the rows ``c`` of ``b``; rows are copied for a few pairs at a time."""
    step = max(1, 1_000_000 // a.shape[1])
    return np.concatenate([np.empty(0), *(_paired(a[q[i : i + step]], b[c[i : i + step]]) for i in range(0, len(q), step))])


def _nearest(a: np.ndarray, b: np.ndarray, bound: np.ndarray, keep: int, metric: str, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, rounded distance) of the ``keep`` nearest rows of ``b`` within each bound, ties to the earlier row.

    Wide euclidean pairs are ruled out by |a|^2 + |b|^2 - 2ab, whose rounding is allowed for;
    what is left gets its distance from explicit differences, as all other pairs do.
    """
    bound = bound + SLACK
    product = metric == "euclidean" and a.shape[1] >= PRODUCT_WIDTH and bool(np.isfinite(a).all() and np.isfinite(b).all())
    if product:
        own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        gaps = a @ b.T
        gaps *= -2.0
        gaps += own[:, None]
        gaps += other
        off = 4 * (a.shape[1] + 8) * np.finfo(np.float64).eps * (own + other.max())
        near = gaps <= (bound * bound + off)[:, None]
    else:
        gaps, off = np.round(_distances(a, b, metric, p), DIGITS), np.zeros(len(a))
        near = gaps <= bound[:, None]
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > keep)
    if len(many):
        kth = np.partition(gaps[many], keep - 1, axis=1)[:, keep - 1]
        kth = np.where(np.isnan(kth), np.inf, kth)
        if product:
            kth = (np.sqrt(np.maximum(kth + off[many], 0.0)) + SLACK) ** 2 + off[many]
        near[many] &= gaps[many] <= kth[:, None]
    q, c = np.nonzero(near)
    found = np.round(_apart(a, q, b, c), DIGITS) if product else gaps[q, c]
    order = np.lexsort((c, found, q))
    q, c, found = q[order], c[order], found[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = (place < keep) & (found <= bound[q])
    return q[best], c[best], found[best]


def _within(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of a, row of b) of all pairs that may lie within each bound, by a product in single precision.

    Both sides are moved by the mean of ``b``, and rounding is allowed for. None where that
    leaves too many pairs or numbers are too large for it.
    """
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if not own.max() + other.max() < 1e30:
        return None
    off = 2 * (a.shape[1] + 8) * np.finfo(np.float32).eps * (own + other.max()) + 1e-36
    most = np.minimum((bound + SLACK) ** 2 + off - own, 1e31).astype(np.float32)
    most = np.nextafter(most, np.float32(np.inf))[:, None]
    left = np.hstack([-2.0 * a, np.ones((len(a), 1))]).astype(np.float32)
    right = np.hstack([b, other[:, None]]).astype(np.float32)
    rows, columns = TILE
    products, mask = np.empty(rows * columns, np.float32), np.empty(rows * columns, bool)
    q, c, room = [], [], len(a) * len(b) // 8 + 1
    for j in range(0, len(b), columns):
        side = np.ascontiguousarray(right[j : j + columns].T)
        for i in range(0, len(a), rows):
            shape = len(left[i : i + rows]), side.shape[1]
            product, near = (x[: shape[0] * shape[1]].reshape(shape) for x in (products, mask))
            np.matmul(left[i : i + rows], side, out=product)
            np.less_equal(product, most[i : i + rows], out=near)
            at = _set(near.reshape(-1))
            room -= len(at)
            if room < 0:
                return None
            q.append(at // shape[1] + i)
            c.append(at % shape[1] + j)
    return np.concatenate(q), np.concatenate(c)


def _set(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few places set is true; eight places are looked at together."""
    if len(mask) % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.view(np.uint64))
    word, place = np.nonzero(mask.reshape(-1, 8)[some])
    return some[word] * 8 + place


class _Best:
    """The ``keep`` nearest points of some queries, over packets of points that come one after the other."""

    def __init__(self, vectors: np.ndarray, keep: int, metric: str, p: float) -> None:
        self.vectors, self.keep, self.metric, self.p = vectors, keep, metric, p
        self.bound = np.full(len(vectors), np.inf)
        self.product = metric == "euclidean" and vectors.shape[1] >= PRODUCT_WIDTH
        self.fine, self.odd = self._parted(vectors)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = 0

    def _parted(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for products and other rows."""
        fine = np.isfinite(vectors).all(axis=1) & self.product
        return np.flatnonzero(fine), np.flatnonzero(~fine)

    def meet(self, vectors: np.ndarray, first: np.ndarray, ids: np.ndarray | None) -> None:
        """Points with their smallest key, in ascending order; ``ids``: all keys of each, if some have several."""
        fine, odd = self._parted(vectors)
        start = FIRST if np.isinf(self.bound[self.fine]).any() else 0
        for rows, points, screened in ((self.fine, fine[:start], False), (self.fine, fine[start:], True), (self.fine, odd, False), (self.odd, np.arange(len(vectors)), False)):
            if not (len(rows) and len(points)):
                continue
            q, c, distance = self._near(rows, vectors[points], screened)
            c = points[c]
            key = first[c]
            if ids is not None:
                times = np.array([len(x) for x in ids[c]], dtype=np.int64)
                q, distance = np.repeat(q, times), np.repeat(distance, times)
                key = np.concatenate([first[:0], *ids[c]]).astype(first.dtype)
            self.found.append((q, distance, key))
            self.new += len(q)
            if np.isinf(self.bound[self.fine]).any() or 2 * self.new >= self.keep * len(self.vectors):
                self.merge()

    def _near(self, rows: np.ndarray, points: np.ndarray, screened: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance): at least the nearest of some queries within their bounds."""
        vectors, bound = self.vectors[rows], self.bound[rows]
        pairs = _within(vectors, points, bound) if screened else None
        if pairs:
            q, c = pairs
            distance = np.round(_apart(vectors, q, points, c), DIGITS)
            near = distance <= bound[q]
            return rows[q[near]], c[near], distance[near]
        some = []
        for i in range(0, len(rows), 256):
            q, c, distance = _nearest(vectors[i : i + 256], points, bound[i : i + 256], self.keep, self.metric, self.p)
            some.append((rows[q + i], c, distance))
        return tuple(np.concatenate(x) for x in zip(*some))

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, distance, key) of the nearest so far, in this order; a row with ``keep`` of them gets its bound."""
        q, distance, key = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((key if key.dtype.kind in "iuf" else pd.factorize(key, sort=True)[0], distance, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.keep]
        q, distance, key = q[place < self.keep], distance[order], key[order]
        last = place[place < self.keep] == self.keep - 1
        self.bound[q[last]] = distance[last]
        self.found, self.new = [(q, distance, key)], 0
        return self.found[0]


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _numbers(df: DataFrame, vector: str) -> Column:
    """The vectors in single precision where they are stored so, else in double precision."""
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(vector).cast("array<float>" if single else "array<double>")


def _distinct_vectors(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """(gid, vec, ids): each distinct vector with its ``keep`` smallest keys.

    The rank filter is applied before the shuffle as well, so a vector held
    by a third of the rows sends only ``keep`` rows per task.
    """
    rows = df.select(F.col(key).alias("id"), _numbers(df, vector).alias("vec")).where("vec is not null")
    order = Window.partitionBy("vec").orderBy("id")
    first = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    # a second window, not groupBy: that would shuffle the vectors again
    copies = Window.partitionBy("vec")
    groups = first.select("vec", "rn", F.min("id").over(copies).alias("gid"), F.array_sort(F.collect_list("id").over(copies)).alias("ids"))
    return groups.where("rn = 1").drop("rn")


class PivotTree:
    """Points under a tree of pivots, as tables: one row for each node of a level.

    A level holds (parent, node, vec, far, reach): the pivot of a node, the distance of
    its farthest point and that of its ``keep``-th nearest (infinite where there are
    fewer). A node has at most ``fan`` children and the tree as many levels as leaves
    of some ``leaf`` points ask for, so no node, and nothing sent to a task, grows with
    the table. ``placed`` holds the points with their leaf.
    """

    def __init__(self, points: DataFrame, keep: int, leaf: int, fan: int, metric: str, p: float) -> None:
        self.metric, self.p, self.keep, self.fan = metric, p, keep, fan
        # what tasks get: no method of this object, which holds tables
        self.gaps = lambda vectors, pivots: _distances(_stack(vectors), _stack(pivots), metric, p)
        self.levels: list[DataFrame] = []
        rows, n = points.withColumn("node", F.lit(0).cast("long")), points.count()
        depth = 0
        while leaf * fan**depth < n:
            depth += 1
        for _ in range(depth):
            rows = self._grow(rows, leaf)
        self.placed = rows

    def _grow(self, rows: DataFrame, leaf: int) -> DataFrame:
        """One level more: pivots are drawn in each node, its points go to the nearest one."""
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.least(F.lit(self.fan), F.ceil(F.col("n") / leaf)))
        # four times the pivots that are needed, by a hash, so that no node is sorted as a whole
        draw = F.pmod(F.xxhash64(F.lit("pivot"), "gid"), F.lit(1 << 30)) * F.col("n") <= 4 * F.col("m") * (1 << 30)
        order = Window.partitionBy("node").orderBy(F.xxhash64("gid"), "gid")
        drawn = rows.join(sizes, "node").filter(draw).withColumn("k", F.row_number().over(order)).filter("k <= m")
        # every node goes on, also one of which no point was drawn
        first = rows.groupBy("node").agg(F.min_by("vec", F.struct(F.xxhash64("gid").alias("h"), F.col("gid"))).alias("vec"))
        lone = first.join(drawn.select("node").distinct(), "node", "left_anti").withColumn("k", F.lit(1))
        pivots = drawn.select("node", "vec", "k").unionByName(lone).select(F.col("node").alias("parent"), (F.col("node") * self.fan + F.col("k") - 1).alias("node"), "vec")
        pivots, gap = materialize(pivots, "knn-pivots"), self.gaps

        def place(batch: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            gaps = gap(batch["vec"], children["vec"])
            best = gaps.argmin(axis=1)
            return batch.assign(node=children["node"].to_numpy()[best], radius=gaps[np.arange(len(batch)), best])

        kept = [c for c in rows.columns if c != "radius"]
        schema = rows.select(*kept).withColumn("radius", F.lit(0.0)).schema
        placed = materialize(self._each(rows.select(*kept), pivots, place, schema), "knn-placed")
        inner = placed.select("node", "radius").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("radius"))).filter(F.col("k") <= self.keep)
        reach = inner.groupBy("node").agg(F.max(F.when(F.col("k") == self.keep, F.col("radius"))).alias("reach"))
        far = placed.groupBy("node").agg(F.max("radius").alias("far"))
        level = pivots.join(far, "node").join(reach, "node").select("parent", "node", "vec", "far", F.coalesce("reach", F.lit(math.inf)).alias("reach"))
        self.levels.append(materialize(level, "knn-level"))
        return placed.drop("radius")

    def _each(self, rows: DataFrame, level: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
        """``kernel(some rows, children)`` for the rows of every node and the children of that node."""
        if not self.levels or level is self.levels[0]:
            children = level.toPandas()  # of the root, at most ``fan``

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for start in range(0, len(batch), 1_000):
                        yield kernel(batch[start : start + 1_000], children)[schema.names]

            return rows.mapInPandas(run, schema)
        lots = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("lanes"))
        asked = rows.join(lots, "node").withColumn("lane", F.pmod(F.xxhash64("gid"), F.col("lanes"))).drop("lanes")
        given = level.join(lots.withColumnRenamed("node", "parent"), "parent").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))

        def both(own: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            done = [kernel(own[start : start + 1_000], children)[schema.names] for start in range(0, len(own), 1_000)]
            return pd.concat(done) if done else pd.DataFrame(columns=schema.names)

        return asked.groupBy("node", "lane").cogroup(given.drop("lanes").groupBy("parent", "lane")).applyInPandas(both, schema)

    def home(self, queries: DataFrame) -> DataFrame:
        """(gid, vec) with the leaf nearest on the way down and a bound on the ``keep``-th distance."""
        rows, gap = queries.select("gid", "vec", F.lit(0).cast("long").alias("node"), F.lit(math.inf).alias("bound")), self.gaps

        def descend(batch: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            gaps = gap(batch["vec"], children["vec"])
            best = gaps.argmin(axis=1)
            bound = (gaps + children["reach"].to_numpy()).min(axis=1)
            return batch.assign(node=children["node"].to_numpy()[best], bound=np.minimum(batch["bound"], bound))

        for level in self.levels:
            rows = materialize(self._each(rows, level, descend, rows.schema), "knn-home")
        return rows

    def visits(self, queries: DataFrame) -> DataFrame:
        """(gid, vec, bound, home, node): leaves besides ``home`` that may hold a point within ``bound``."""
        rows, gap = queries.select("gid", "vec", "bound", "home", F.lit(0).cast("long").alias("node")), self.gaps
        if not self.levels:
            return rows.filter("false")

        def within(batch: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            gaps = gap(batch["vec"], children["vec"])
            bound = batch["bound"].to_numpy()[:, None] + SLACK
            nearest = gaps.min(axis=1, keepdims=True)
            q, c = np.nonzero((gaps - children["far"].to_numpy() <= bound) & ((gaps - nearest) / 2 <= bound))
            return batch.iloc[q].assign(node=children["node"].to_numpy()[c])

        for level in self.levels:
            rows = materialize(self._each(rows, level, within, rows.schema), "knn-visits")
        return rows.filter("node <> home")


def _search(asked: DataFrame, placed: DataFrame, tree: PivotTree, key_type: str, block_points: int, block_queries: int) -> DataFrame:
    """(qid, neighbour, distance): the ``keep`` best of each query in each block of its leaf, within its bound."""
    keep, metric, p = tree.keep, tree.metric, tree.p
    lanes = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("lanes"))
    lots = lanes.join(placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block_points).alias("blocks")), "node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("gid"), F.col(n))
    sent = asked.join(lots, "node").withColumn("lane", one("lanes")).withColumn("block", every("blocks")).select("node", "block", "lane", F.col("gid").alias("qid"), F.col("vec").alias("qvec"), "bound")
    held = placed.join(lots, "node").withColumn("block", one("blocks")).withColumn("lane", every("lanes")).select("node", "block", "lane", "gid", "ids", "vec")

    def search(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found = {"qid": [], "neighbour": [], "distance": []}
        if not len(asked) or not len(given):
            return pd.DataFrame(found)
        given = given.sort_values("gid").reset_index(drop=True)
        ids, first, vectors = given["ids"].to_numpy(), given["gid"].to_numpy(), _stack(given["vec"])
        alone = all(len(x) == 1 for x in ids)
        parts = []
        for start in range(0, len(asked), 256):
            part = asked[start : start + 256]
            # rows are ordered by key: ties go to the smaller key
            q, at, near = _nearest(_stack(part["qvec"]), vectors, part["bound"].to_numpy(), keep, metric, p)
            qid = part["qid"].to_numpy()[q]
            if alone:
                parts.append(pd.DataFrame({"qid": qid, "neighbour": first[at], "distance": near}))
                continue
            rows = pd.DataFrame({"q": q, "qid": qid, "neighbour": ids[at], "distance": near}).explode("neighbour")
            rows["neighbour"] = rows["neighbour"].astype(given["gid"].dtype)
            parts.append(rows.sort_values(["q", "distance", "neighbour"]).groupby("q").head(keep)[["qid", "neighbour", "distance"]])
        return pd.concat(parts)

    by = ["node", "block", "lane"]
    return sent.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, f"qid {key_type}, neighbour {key_type}, distance double")


def _packets(points: DataFrame, width: int) -> DataFrame:
    """(gids, ids, vecs): the points in packets of bounded size, in the order of their keys; ``ids`` only where a point has several."""
    single = points.schema["vec"].dataType.elementType == T.FloatType()
    number, key_type = np.dtype(np.float32 if single else np.float64), points.schema["gid"].dataType.simpleString()
    most = max(1, PACKET_BYTES // (width * number.itemsize))

    def packet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gid")
        alone = all(len(x) == 1 for x in rows["ids"])
        return pd.DataFrame({"gids": [rows["gid"].tolist()], "ids": [None if alone else rows["ids"].tolist()], "vecs": [_stack(rows["vec"]).astype(number).tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while len(held) >= most:
                yield packet(held[:most])
                held = held[most:]
        if held is not None and len(held):
            yield packet(held)

    rows = points.where("gid is not null").select("gid", "ids", "vec")
    # small row groups: readers can share a file
    return materialize(rows.mapInPandas(pack, f"gids array<{key_type}>, ids array<array<{key_type}>>, vecs binary"), "knn-packets", **{"parquet.block.size": 4 * PACKET_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4})


def _unpacked(packet: bytes, points: int, single: bool) -> np.ndarray:
    return np.frombuffer(packet, np.float32 if single else np.float64).reshape(points, -1).astype(np.float64)


def _visited(packets: DataFrame, points: DataFrame, queries: DataFrame, children: int, keep: int, metric: str, p: float) -> float:
    """Of so many children of a pivot tree's root, how many hold the points that a query has to meet: the mean of some queries.

    Their ``keep``-th distances and the reach of the pivots come from all points, in one pass.
    """
    single = points.schema["vec"].dataType.elementType == T.FloatType()
    few = lambda rows, salt, n: rows.select("vec", F.xxhash64(F.lit(salt), "gid").alias("h"), "gid").orderBy("h", "gid").limit(n).toPandas()["vec"]
    pivots, asked = few(points, "pivot", children), few(queries, "asked", ASKED)
    if not len(asked):
        return 0.0
    pivots, asked = _stack(pivots), _stack(asked)

    def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric != "euclidean":
            return np.nan_to_num(_distances(a, b, metric, p), nan=np.inf)
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)
        return np.nan_to_num(np.sqrt(np.maximum(square, 0.0)), nan=np.inf)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, held, near = np.zeros(len(pivots)), np.zeros(len(pivots)), np.empty((len(asked), 0))
        for batch in batches:
            for first, packet in zip(batch["gids"], batch["vecs"]):
                vectors = _unpacked(packet, len(first), single)
                own = gaps(vectors, pivots)
                best = own.argmin(axis=1)
                np.maximum.at(far, best, own[np.arange(len(own)), best])
                held += np.bincount(best, minlength=len(pivots))
                near = np.sort(np.hstack([near, gaps(asked, vectors)]), axis=1)[:, :keep]
        yield pd.DataFrame({"asked": False, "at": range(len(pivots)), "far": far, "held": held, "near": None})
        yield pd.DataFrame({"asked": True, "at": range(len(asked)), "far": 0.0, "held": 0.0, "near": list(near)})

    found = packets.select("gids", "vecs").mapInPandas(measure, "asked boolean, at int, far double, held double, near array<double>")
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near")
    sums = found.groupBy("asked", "at").agg(F.max("far").alias("far"), F.sum("held").alias("held"), nearest).toPandas().sort_values("at")
    far, held = (sums[~sums["asked"]][c].to_numpy() for c in ("far", "held"))
    bound = np.array([x[keep - 1] if len(x) == keep else np.inf for x in sums[sums["asked"]]["near"]])[:, None]
    away = gaps(asked, pivots)
    visits = (away - far <= bound) & ((away - away.min(axis=1, keepdims=True)) / 2 <= bound)
    return float((visits @ held).mean() / held.sum() * len(pivots))


def _meet_all(queries: DataFrame, points: DataFrame, parts: int, single: tuple[bool, bool], key_types: tuple[str, str], keep: int, metric: str, p: float) -> DataFrame:
    """(qid, distance, neighbour): the ``keep`` best of each query in each of ``parts`` parts of the points, side by side.

    A task takes packets of queries and one part of the packets of points; nothing is shuffled.
    """

    def answer(asked: np.ndarray, best: _Best) -> pd.DataFrame:
        q, distance, key = best.merge()
        ends = np.searchsorted(q, np.arange(1, len(asked)))
        return pd.DataFrame({"qid": asked, "distance": np.split(distance, ends), "neighbour": np.split(key, ends)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = None
        for batch in batches:
            for packet, asked, qvecs, first, ids, vecs in zip(*(batch[c] for c in ("packet", "asked", "qvecs", "gids", "ids", "vecs"))):
                if now is None or now[0] != packet:
                    if now:
                        yield answer(*now[1:])
                    now = packet, asked, _Best(_unpacked(qvecs, len(asked), single[0]), keep, metric, p)
                now[2].meet(_unpacked(vecs, len(first), single[1]), first, ids)
        if now:
            yield answer(*now[1:])

    asked = queries.select(F.monotonically_increasing_id().alias("packet"), F.col("gids").alias("asked"), F.col("vecs").alias("qvecs"))
    pairs = asked.crossJoin(points.coalesce(parts).hint("shuffle_replicate_nl"))
    return pairs.mapInPandas(search, f"qid {key_types[0]}, distance array<double>, neighbour array<{key_types[1]}>")


def _lists_of_all(queries: DataFrame, points: DataFrame, width: int, keep: int, metric: str, p: float, leaf: int, fan: int) -> DataFrame | None:
    """(qid, near): the ``keep`` nearest points of every query, out of all; None where a tree of pivots rules most of them out."""
    packets = _packets(points, width)
    asked = packets if queries is points else _packets(queries, width)
    n = points.count()
    children = min(fan, math.ceil(n / leaf))
    if children > VISITS and _visited(packets, points, queries, children, keep, metric, p) < min(VISITS, children / 2):
        return None
    single = tuple(x.schema["vec"].dataType.elementType == T.FloatType() for x in (queries, points))
    kinds = tuple(x.schema["gid"].dataType.simpleString() for x in (queries, points))
    parts = math.ceil(n * width * (4 if single[1] else 8) / PART_BYTES)
    found = _meet_all(asked, packets, parts, single, kinds, keep, metric, p)
    # arrays side by side take half the room of structs
    some = found.groupBy("qid").agg(F.collect_list(F.struct("distance", "neighbour")).alias("some"))
    near = F.flatten(F.transform("some", lambda x: F.arrays_zip(x["distance"].alias("distance"), x["neighbour"].alias("neighbour"))))
    return some.select("qid", F.slice(F.array_sort(near), 1, keep).alias("near"))


def _lists_by_tree(queries: DataFrame, points: DataFrame, key_type: str, keep: int, metric: str, p: float, block_points: int, block_queries: int, fan: int) -> DataFrame:
    """(qid, near): the ``keep`` nearest points of every query, by a tree of pivots."""
    tree = PivotTree(points, keep, block_points, fan, metric, p)
    home = tree.home(queries)
    near = materialize(_search(home, tree.placed, tree, key_type, block_points, block_queries), "knn-home-found")
    best = Window.partitionBy("qid").orderBy("distance", "neighbour")
    top = lambda found: found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= keep)
    kth = top(near).where(F.col("rn") == keep).select(F.col("qid").alias("gid"), F.col("distance").alias("kth"))
    bounded = home.join(kth, "gid", "left").select("gid", "vec", F.col("node").alias("home"), F.least("bound", "kth").alias("bound"))
    elsewhere = _search(tree.visits(bounded), tree.placed, tree, key_type, block_points, block_queries)
    return top(near.unionByName(elsewhere)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))


def knn_join(
    queries: DataFrame,
    key: str,
    vector: str,
    k: int,
    points: DataFrame | None = None,
    metric: str = "euclidean",
    p: float = 2.0,
    block_points: int | None = None,
    block_queries: int | None = None,
    pivots: int = FAN,
) -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest points of every query.

    With no ``points`` the table is joined with itself and a row is not its
    own neighbour.  Distances are rounded to nine digits; ties go to the
    smaller key.  Rows without a vector are left out.

    A query searches the leaf it descends to first; the k-th distance found
    there bounds which other leaves it has to visit.  A node of the tree has
    at most ``pivots`` children, a leaf about ``block_points`` points; by default
    the blocks of both sides follow from the width of the vectors.  Wide vectors
    that would visit many leaves meet all points, packet by packet.
    """
    own = points is None
    keep = k + 1 if own else k
    # both are read by several jobs below, so each is written once
    point_set = materialize(_distinct_vectors(queries if own else points, key, vector, keep), "knn-points")
    query_set = point_set if own else materialize(_distinct_vectors(queries, key, vector, 1), "knn-queries")
    key_type = queries.schema[key].dataType.simpleString()
    width = point_set.agg(F.max(F.size("vec")).alias("n")).first()["n"] or 0
    wide = width >= WIDE
    block_points = block_points or (WIDE_BLOCK if wide else BLOCK_POINTS)
    block_queries = block_queries or (WIDE_BLOCK if wide else BLOCK_QUERIES)

    lists = _lists_of_all(query_set, point_set, width, keep, metric, p, block_points, pivots) if wide else None
    if lists is None:
        lists = _lists_by_tree(query_set, point_set, key_type, keep, metric, p, block_points, block_queries, pivots)

    # back to rows: equal vectors share one answer
    rows = queries.select(F.col(key).alias("id"), _numbers(queries, vector).alias("vec"))
    if own and point_set.count() == queries.count():
        answered = lists.withColumnRenamed("qid", "id")
    else:
        # as large as the table, though the file of it may be small: not sent whole through the driver
        groups = query_set.select(F.col("gid").alias("qid"), F.col("vec").alias("gvec")).hint("merge")
        answered = rows.join(groups, F.col("vec") == F.col("gvec")).join(lists, "qid").select("id", "near")
    if own:
        answered = answered.withColumn("near", F.filter("near", lambda s: s["neighbour"] != F.col("id")))
    top_k = answered.select("id", F.posexplode(F.slice("near", 1, k)).alias("pos", "n"))
    return top_k.select(
        F.col("id").alias(key), (F.col("pos") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance")
    )


def knn_predict(
    neighbours: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, weights: str = "uniform", task: str = "classification"
) -> DataFrame:
    """Vote or mean over the neighbours; with distance weights a zero distance decides alone."""
    joined = neighbours.join(labels.select(F.col(label_key).alias("neighbour"), F.col(label).alias("__y")).hint("merge"), "neighbour")
    if weights == "distance":
        nearest = F.min("distance").over(Window.partitionBy(key))
        w = F.when(nearest == 0, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
        joined = joined.withColumn("__w", w)
    else:
        joined = joined.withColumn("__w", F.lit(1.0))
    if task == "regression":
        mean = F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")
        return joined.groupBy(key).agg(mean.alias("prediction"))
    # one shuffle on the row key serves both aggregates
    votes = joined.repartition(key).groupBy(key, "__y").agg(F.round(F.sum("__w"), DIGITS).alias("__v"))
    best = F.min_by("__y", F.struct((-F.col("__v")).alias("v"), F.col("__y").alias("y")))
    return votes.groupBy(key).agg(best.alias("prediction"))


def local_outlier_factor(df: DataFrame, key: str, vector: str, k: int = 20, contamination: float = 0.1) -> DataFrame:
    """(key, lof, outlier): density of the neighbours over the own density."""
    pairs = materialize(knn_join(df, key, vector, k), "lof-pairs")
    reach = pairs.groupBy(key).agg(F.max("distance").alias("kdist"))
    far = reach.select(F.col(key).alias("neighbour"), "kdist")
    density = (
        pairs.join(far, "neighbour").groupBy(key).agg((1.0 / (F.avg(F.greatest("distance", "kdist")) + 1e-10)).alias("lrd"))
    )
    density = materialize(density, "lof-density")
    around = pairs.join(density.select(F.col(key).alias("neighbour"), F.col("lrd").alias("lrd_n")), "neighbour")
    mean = around.groupBy(key).agg(F.avg("lrd_n").alias("lrd_n"))
    scored = materialize(
        mean.join(density, key).select(key, F.round(F.col("lrd_n") / F.col("lrd"), DIGITS).alias("lof")), "lof-scores"
    )
    cut = exact_quantiles(scored, ["lof"], [1.0 - contamination])["lof"][0]
    return scored.withColumn("outlier", F.col("lof") > F.lit(cut))
