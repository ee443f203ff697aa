"""Near-duplicate embeddings through robust-pruned graphs on overlapping cluster shards.

1. Equal unit vectors become one, weighted by how many they are.
2. A bounded sample gives cluster centres for each vector length; every vector joins
   its nearest few shards, and a shard is dealt into blocks of bounded size.
3. Each block builds a flat graph: the nearest candidates of a vector, pruned so that
   the neighbours kept point in different directions. The adjacency lists of a vector
   from all its shards are united.
4. Each pair of blocks of a shard is searched: the members of one walk greedily over the
   graph of the other from its medoids, and from their own node where they have one, then
   expand through everything within range. What is found is verified by cosine in
   double precision; a link found from either end holds for both, and a pair that meets
   in several shards counts in the first one they share. Counts and local components
   leave a task, pairs never do.
5. An audit compares vectors with all others; while too few of their links were found,
   the search is repeated with twice the overlap and beam. Where that does not help, the
   blocks of one shard for each length are compared in full, which misses nothing.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.components import components
from loomframe.session import materialize

_LOG = logging.getLogger(__name__)

#: Vectors that the centres are fitted on (documented bound; so there are no more centres,
#: whose table is what every executor gets), and vectors a centre stands for.
SAMPLE, PER_SHARD = 20_000, 1_000
#: Members of a block; larger shards are cut into blocks, and a task searches one for another.
BLOCK = 20_000
#: Nearest candidates, neighbours of a node, those of them that lead far away (drawn among
#: the block), slack of the pruning.
CANDIDATES, DEGREE, FAR, SLACK = 48, 24, 6, 1.2
#: (query, node) pairs that a task keeps marks of, and pairs scored at a time.
PAIRS, SCORED = 2_000_000, 200_000
#: Equal vectors from which on their result is sent to every executor; so it has a row for every HOT vectors at most.
HOT = 1_000
#: Vectors that the audit compares with all others besides those with an identifier that
#: SHARE divides, and vectors of a pass.
AUDITED, SHARE, AUDIT_PASS = 512, 100, 20_000


def unit_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (of equal units), unit (double array); both null where the vector cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            out: list[np.ndarray | None] = []
            keys: list[bytes | None] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                x = flat[lo:hi]
                top = np.abs(x).max() if hi > lo else 0.0
                if not (np.isfinite(top) and top > 0):
                    out.append(None)
                    keys.append(None)
                    continue
                # Scaling by the largest component first keeps squares within range.
                x = x / top
                out.append(x / np.sqrt((x * x).sum()) + 0.0)  # no negative zeros
                keys.append(hashlib.blake2b(out[-1].tobytes(), digest_size=16).digest())
            yield pa.record_batch([batch.column("id"), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.float64()))], names=["id", "key", "unit"])

    base = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return base.mapInArrow(run, "id long, key binary, unit array<double>")


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(sample), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def fit_shards(sample: list[np.ndarray], counts: dict[int, int]) -> dict[int, tuple[int, np.ndarray | None]]:
    """For each vector length its first shard and its centres, one shard a centre.

    A length without a sampled vector, or with few vectors, is one shard without a centre.
    """
    drawn: dict[int, list[np.ndarray]] = {}
    for v in sample:
        drawn.setdefault(len(v), []).append(v)
    out, first = {}, 0
    for size, n in sorted(counts.items()):
        own = drawn.get(size, [])
        k = min(len(own), -(-n // PER_SHARD))
        out[size] = (first, centres(np.stack(own), k) if k > 1 else None)
        first += max(1, k)
    return out


def assign(units: DataFrame, places: dict[int, tuple[int, np.ndarray | None]], overlap: int) -> DataFrame:
    """All columns and shards: the ``overlap`` nearest centres of the vector's length, in ascending order."""
    shared = units.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for rows, x in matrices(batch.column("unit")):
                first, c = shared.value[x.shape[1]]
                near = np.zeros((len(x), 1), int)
                if c is not None:
                    take = min(overlap, len(c))
                    near = np.sort(np.argpartition(-(x @ c.T), take - 1, axis=1)[:, :take], axis=1)
                for k, own in zip(rows.tolist(), (first + near).astype(np.int32)):
                    shards[k] = own
            yield pa.record_batch([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(run, f"{fields}, shards array<int>")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length in the column."""
    sizes = np.array(column.value_lengths(), np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), -1)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest place of a place's component) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def pruned_graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Robust-pruned neighbour places of each row of float32 units, -1 where there are fewer than DEGREE.

    The last FAR neighbours are picked among candidates drawn from all rows, so that a
    walk gets from one dense region to another.
    """
    m = len(x)
    out = np.full((m, DEGREE), -1, np.int64)
    wide = min(CANDIDATES, m - 1)
    if wide < 1:
        return out
    rng = np.random.default_rng(seed)
    step = max(1, min(512, PAIRS // m))
    for a in range(0, m, step):
        sims = x[a : a + step] @ x.T
        rows = np.arange(len(sims))
        sims[rows, a + rows] = -2
        cand = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        cand = np.concatenate([cand, rng.integers(0, m, (len(rows), 2 * FAR))], 1)
        far = 2 - 2 * np.take_along_axis(sims, cand, 1)
        bodies = x[cand]
        alive = cand != (a + rows)[:, None]
        drawn = np.arange(cand.shape[1]) >= wide
        for k in range(DEGREE):
            turn = drawn if k >= DEGREE - FAR else ~drawn
            pick = np.where(alive & turn, far, np.inf).argmin(1)
            has = (alive & turn)[rows, pick]
            out[a + rows[has], k] = cand[rows[has], pick[has]]
            # A candidate nearer to the pick than, with slack, to the node is reached through it.
            to_pick = 2 - 2 * np.einsum("ijk,ik->ij", bodies, bodies[rows, pick])
            alive &= (SLACK * to_pick > far) | ~has[:, None]
            alive[rows[has], pick[has]] = False
    return out


class Graph:
    """Mutual adjacency lists over the places of a block: ``ends[k]:ends[k + 1]`` of ``near`` are those of place k."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, lists: list[np.ndarray]):
        m = len(ids)
        node = np.repeat(np.arange(m), [len(one) for one in lists])
        near = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, near, sorter=order), m - 1)]
        here = (ids[at] == near) & (at != node)  # neighbours of other shards are not members
        node, at = node[here], at[here]
        # What points at a node can be reached from it.
        both = np.unique(np.concatenate([node * m + at, at * m + node]))
        self.near = both % m
        self.ends = np.searchsorted(both // m, np.arange(m + 1))
        self.x = x
        # Walks start from the medoid of each part that is connected.
        part = merged(np.arange(m), both // m, both % m)
        sums = np.zeros_like(x)
        np.add.at(sums, part, x)
        order = np.lexsort((-np.einsum("ij,ij->i", x, sums[part]), part))
        self.medoids = order[np.unique(part[order], return_index=True)[1]]

    def around(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) for each neighbour of each row's node."""
        n = self.ends[nodes + 1] - self.ends[nodes]
        first = np.repeat(self.ends[nodes] - (np.cumsum(n) - n), n)
        return np.repeat(rows, n), self.near[first + np.arange(len(first))]


def range_search(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float, beam: int) -> np.ndarray:
    """(query, node) marks of all nodes found within range. ``own`` is a query's node, or -1."""
    m, q = len(graph.x), len(queries)
    seen, near, expanded = np.zeros((q, m), bool), np.zeros((q, m), bool), np.zeros((q, m), bool)
    wide = min(beam, m)
    node, score = np.zeros((q, wide), np.int64), np.full((q, wide), -3, np.float32)
    spent = np.ones((q, wide), bool)

    def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs not seen before, with their similarities."""
        fresh = ~seen[rows, nodes]
        rows, nodes = rows[fresh], nodes[fresh]
        seen[rows, nodes] = True
        sims = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), SCORED):
            part = slice(at, at + SCORED)
            sims[part] = np.einsum("ij,ij->i", queries[rows[part]], graph.x[nodes[part]])
        hit = sims >= least - 1e-3  # single precision; what is found is verified in double
        near[rows[hit], nodes[hit]] = True
        return rows, nodes, sims

    def push(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Put pairs into the beams of their queries, which keep their best."""
        rows, nodes, sims = look(rows, nodes)
        if not len(rows):
            return
        order = np.lexsort((-sims, rows))
        rows, nodes, sims = rows[order], nodes[order], sims[order]
        which, first, place = np.unique(rows, return_index=True, return_inverse=True)
        rank = np.arange(len(rows)) - first[place]
        place, nodes, sims, rank = (z[rank < wide] for z in (place, nodes, sims, rank))
        shape = (len(which), int(rank.max()) + 1)
        new_n, new_s, new_e = np.zeros(shape, np.int64), np.full(shape, -3, np.float32), np.ones(shape, bool)
        new_n[place, rank], new_s[place, rank], new_e[place, rank] = nodes, sims, False
        all_s = np.concatenate([score[which], new_s], 1)
        top = np.argpartition(-all_s, wide - 1, axis=1)[:, :wide]
        score[which] = np.take_along_axis(all_s, top, 1)
        node[which] = np.take_along_axis(np.concatenate([node[which], new_n], 1), top, 1)
        spent[which] = np.take_along_axis(np.concatenate([spent[which], new_e], 1), top, 1)

    active = np.arange(q)
    push(np.repeat(active, len(graph.medoids)), np.tile(graph.medoids, q))
    push(active[own >= 0], own[own >= 0])
    while True:
        # The best unexpanded node of each beam; a beam whose nodes are all expanded is finished.
        best = np.where(spent[active], np.float32(-3), score[active]).argmax(1)
        go = ~spent[active, best]
        active, best = active[go], best[go]
        if not len(active):
            break
        spent[active, best] = True
        expanded[active, node[active, best]] = True
        push(*graph.around(active, node[active, best]))
    while True:
        rows, nodes = np.nonzero(near & ~expanded)
        if not len(rows):
            return near
        expanded[rows, nodes] = True
        for at in range(0, len(rows), SCORED // DEGREE):
            r, n = graph.around(rows[at : at + SCORED // DEGREE], nodes[at : at + SCORED // DEGREE])
            pairs = np.unique((r * m + n)[~seen[r, n]])
            look(pairs // m, pairs % m)


def _blocks(assigned: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """A row for each shard of a vector, with the number ``n`` of its blocks and the vector's ``own``."""
    # One row for each shard of more than one block.
    cut = assigned.sparkSession.createDataFrame([(s, n) for s, n in blocks.items() if n > 1], "shard int, n int")
    rows = assigned.withColumn("shard", F.explode("shards")).join(F.broadcast(cut), "shard", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return rows.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("n")).cast("int"))


def build_lists(assigned: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(id, near): the united adjacency lists of each vector, at most DEGREE neighbours from each of its few shards."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        ids = group["id"].to_numpy()
        graph = pruned_graph(np.stack(group["unit"].to_numpy()))
        return pd.DataFrame({"id": ids, "near": [ids[row[row >= 0]] for row in graph]})

    rows = _blocks(assigned, blocks).select("shard", "own", "id", F.col("unit").cast("array<float>").alias("unit"))
    built = rows.groupBy("shard", "own").applyInPandas(run, "id long, near array<long>")
    return built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _spread(assigned: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """A row for each (shard, low, high) pair of blocks that a vector takes part in; ``own`` is its block."""
    rows = _blocks(assigned, blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # Only the nodes of the graph that is searched need their lists.
    near = F.when(F.col("own") == high, F.col("near"))
    return rows.select("shard", low.alias("low"), high.alias("high"), "own", "id", "w", "unit", "shards", near.alias("near"))


def found_pairs(left: np.ndarray, right: np.ndarray, own: np.ndarray, graph: Graph | None, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, marks of pairs with rows of ``right``) for runs of rows of ``left``, verified in double precision.

    Without a graph all pairs are compared. Where the nodes themselves are the queries,
    a pair found from either end is marked at both.
    """
    step = max(8, PAIRS // max(1, len(right)) // 8 * 8)
    if graph is None:
        for at in range(0, len(left), step):
            yield at, left[at : at + step] @ right.T >= least
        return
    bits = []
    for at in range(0, len(left), step):
        mark = range_search(graph, left[at : at + step].astype(np.float32), own[at : at + step], least, beam)
        r, c = np.nonzero(mark)
        for k in range(0, len(r), SCORED):
            i, j = r[k : k + SCORED], c[k : k + SCORED]
            mark[i, j] = np.einsum("ij,ij->i", left[at + i], right[j]) >= least
        bits.append(np.packbits(mark, axis=1))
    packed = np.concatenate(bits)
    for at in range(0, len(left), step):
        mark = np.unpackbits(packed[at : at + step], axis=1, count=len(right)).view(bool)
        if (own >= 0).all():
            mark |= np.unpackbits(packed[:, at // 8 : -(-(at + len(mark)) // 8)], axis=1, count=len(mark)).view(bool).T
        yield at, mark


def search_shards(assigned: DataFrame, blocks: dict[int, int], least: float, beam: int | None) -> DataFrame:
    """(id, links, root) of the vectors with a link, for each pair of blocks they were searched in; without ``beam`` compared in."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, low, high = map(int, key)
        group = group.sort_values("id", ignore_index=True)
        block, ids, weight = (group[c].to_numpy() for c in ("own", "id", "w"))
        units, shards = np.stack(group["unit"].to_numpy()), np.stack(group["shards"].to_numpy())
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if not (len(left) and len(right)):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        nodes = units[right]
        graph = None if beam is None else Graph(nodes.astype(np.float32), ids[right], list(group["near"].iloc[right]))
        own = np.arange(len(left)) if low == high else np.full(len(left), -1)
        for at, mark in found_pairs(units[left], nodes, own, graph, least, beam or 0):
            r, c = np.nonzero(mark)
            a, b = left[at + r], right[c]
            if low == high:
                a, b = a[a < b], b[a < b]
            label = merged(label, a, b)
            # What meets in an earlier shard as well counts there.
            early = np.zeros(len(a), bool)
            for k in range(shards.shape[1]):
                mine = shards[a, k]
                early |= (mine < shard) & (shards[b] == mine[:, None]).any(1)
            a, b = a[~early], b[~early]
            for x, y in ((a, b), (b, a)):
                links += np.bincount(x, weight[y], len(ids)).astype(np.int64)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[label[some]]})

    return _spread(assigned, blocks).groupBy("shard", "low", "high").applyInPandas(run, "id long, links long, root long")


def true_links(nodes: DataFrame, queries: pd.DataFrame, least: float) -> DataFrame:
    """(id, true) of each query: its links by comparison with all ``nodes``."""
    by_size = {n: (g["id"].to_numpy(), np.stack(g["unit"].to_numpy())) for n, g in queries.groupby(queries["unit"].map(len))}
    shared = nodes.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(own), np.int64) for n, (own, _) in shared.value.items()}
        for batch in batches:
            ids, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "w"))
            for rows, x in matrices(batch.column("unit")):
                if x.shape[1] not in total:
                    continue
                own, units = shared.value[x.shape[1]]
                step = max(1, PAIRS // len(x))
                for at in range(0, len(own), step):
                    hit = (units[at : at + step] @ x.T >= least) & (own[at : at + step, None] != ids[rows][None, :])
                    total[x.shape[1]][at : at + step] += hit @ weight[rows]
        for n, (own, _) in shared.value.items():
            yield pa.record_batch([pa.array(own), pa.array(total[n])], names=["id", "true"])

    return nodes.select("id", "unit", "w").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))


def audit_truth(nodes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(id, true) of the audited vectors that have a link to another distinct vector.

    Those are a share of all, some by hash, and some of those that ``found`` has a link
    of, so that a table with few links has links to measure by.
    """
    some = [t.orderBy(F.xxhash64("id"), "id").limit(AUDITED).select("id") for t in (nodes, found)]
    chosen = some[0].union(some[1]).union(nodes.filter(F.col("id") % SHARE == 0).select("id")).distinct()
    chosen = materialize(nodes.join(chosen, "id", "left_semi").select("id", "unit"), "audited")
    passes = max(1, -(-chosen.count() // AUDIT_PASS))
    known = nodes.sparkSession.createDataFrame([], "id long, true long")
    for k in range(passes):
        queries = chosen.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(passes)) == k).toPandas()
        if len(queries):
            known = known.unionByName(materialize(true_links(nodes, queries, least), "audit-pass"))
    return materialize(known.filter(F.col("true") > 0), "audit-truth")


def audit(truth: DataFrame, found: DataFrame) -> float:
    """Share of its true links that ``found`` (id, links) holds of a vector, on average over those with a link; 1 without any."""
    share = F.avg(F.least("true", F.coalesce("links", F.lit(0))) / F.col("true"))
    value = truth.join(found, "id", "left").agg(share).first()[0]
    return 1.0 if value is None else value


def near_vectors(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", overlap: int = 2, beam: int = 32, recall: float = 0.99, tries: int = 3) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link at a cosine of ``least`` or more, in double precision; never below
    it. Vectors link with vectors of their own length, whatever lengths there are.
    Null, zero and non-finite vectors, vectors with a null component and null
    identifiers link with nothing. Rows that repeat an identifier are one vector
    (the smallest of them); each gets its result. The search ends when the audited
    recall, which is logged, reaches ``recall``; after ``tries`` searches, each with twice
    the overlap and beam of the one before, all vectors of a length are compared with all.
    An empty table gives an empty result; other columns are not read.
    """
    every = materialize(unit_vectors(table, id_col, vec_col), "unit-vectors")
    usable = every.filter("unit is not null and id is not null")
    if usable.isEmpty():
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    units = materialize(usable.groupBy("id").agg(F.min(F.struct("unit", "key")).alias("v")).select("id", "v.key", "v.unit"), "vectors")
    # Equal vectors are searched once, as the one with the smallest identifier.
    equal = materialize(units.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("w")), "equal-vectors")
    nodes = materialize(units.join(equal.select(F.col("least").alias("id"), "w"), "id").select("id", "unit", "w"), "distinct-vectors")
    # One row for each length; T components have at most the root of 2 T lengths.
    counts = {r["n"]: r["count"] for r in nodes.groupBy(F.size("unit").alias("n")).count().collect()}
    sample = nodes.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE).select("unit").toPandas()
    places, truth = fit_shards(list(sample["unit"]), counts), None
    for attempt in range(tries + 1):
        whole = attempt == tries
        if whole:
            places = {size: (k, None) for k, size in enumerate(sorted(counts))}
        assigned = materialize(assign(nodes, places, overlap << attempt), "shard-members")
        sizes = assigned.select(F.explode("shards").alias("s")).groupBy("s").count().collect()  # one row per shard
        blocks = {r["s"]: -(-r["count"] // BLOCK) for r in sizes}
        if whole:
            members = assigned.withColumn("near", F.lit(None).cast("array<long>"))
        else:
            members = assigned.join(materialize(build_lists(assigned, blocks), "adjacency"), "id")
        rows = materialize(search_shards(members, blocks, least, None if whole else beam << attempt), "shard-links")
        found = materialize(rows.groupBy("id").agg(F.sum("links").alias("links")), "vector-links")
        if whole:
            break
        truth = audit_truth(nodes, found, least) if truth is None else truth
        reached = audit(truth, found)
        _LOG.info("overlap %d, beam %d: audited recall %.4f", overlap << attempt, beam << attempt, reached)
        if reached >= recall:
            break
    parts = components(rows.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    own = equal.join(found.withColumnRenamed("id", "least"), "least", "left").join(parts.withColumnRenamed("node", "least"), "least", "left")
    own = materialize(own.select("key", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "results-of-equals")
    # Results of many equal vectors are sent, so that they do not meet in one task.
    sent, dealt, keys = F.broadcast(own.filter(F.col("w") > HOT)), own.filter(F.col("w") <= HOT), units.select("id", "key")
    each = keys.join(sent, "key").unionByName(keys.join(sent.select("key"), "key", "left_anti").join(dealt, "key"))
    result = every.select("id").join(each, "id", "left")
    component = F.coalesce("component", "id")
    return result.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
