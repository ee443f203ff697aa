"""Near-duplicate documents by a grouped prefix join on word shingles.

Texts are never shuffled, and no group of similar documents becomes all of its pairs:

1. One pass names the distinct shingle sets and finds the frequent shingles; they
   come last in the order of shingles, whose head is a set's prefix.
2. One pass collapses documents with identical prefix and size into a group and sends
   (shingle, group) entries, packed by ranges of shingles. Short lists of groups that
   share a shingle give all their pairs of fitting size; long ones give each member
   a pivot and two random neighbours, and are kept for step 4.
3. Group pairs are expanded to their members. A small bit map of each set bounds what
   two sets can share; pairs that cannot link go. One pair for each set is verified
   on the shingles themselves, and the links found give components.
4. Of the other pairs only those whose members are still in different components can
   change the result; they are verified until no such pair is left.
5. Of the pairs that step 2 left out in long lists, bit maps tell which components may
   link at all. Components that may are put into clusters; the sets of a cluster meet in
   tasks, which compare them exactly and give one link for each two components joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.bytewords import mix, release, text_chunks
from loomframe.llm.common import id_and_text
from loomframe.llm.components import components
from loomframe.llm.membership import build, perhaps
from loomframe.llm.rows import text_key
from loomframe.llm.shingles import shingle_sets
from loomframe.session import materialize

#: Shingles that a task counts at once; frequent shingles kept for the order (8 bytes
#: and a level each on every executor); they change the speed, never the result.
COUNTED, FREQUENT = 1_000_000, 400_000
#: Entries a task of step 2 handles at once, and entries of one shingle in one block.
ENTRIES, BLOCK = 250_000, 1_000_000
#: Rounds that verify one pair for each component before all open pairs are; each costs some jobs.
THINNED = 1
#: Longest list that gives all its pairs at once.
SHORT = 8
#: Members of a part of a long list, two of which a task compares, and pairs that leave it at once.
PART, EMITTED = 2_000, 500_000
#: Shingles of a part of a cluster, two of which a task compares.
WEIGHT = 500_000
#: Bytes of a shingle's hash that the comparison reads; a wrong match of two of
#: n shingles has the chance n * n / 2^48.
KEPT_BYTES = 6


def need(n: Column | np.ndarray):
    """Shingles that a set of ``n`` shares at least with any partner: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def signature(sets: np.ndarray) -> int:
    """64 bits that name a set, as a signed integer."""
    mixed = mix(sets + np.uint64(0x51ED270B))
    return int((mixed.sum(dtype=np.uint64) + mix(np.array([len(sets)], np.uint64)) ^ np.bitwise_xor.reduce(mixed)).astype(np.int64)[0])


def bit_map(sets: np.ndarray) -> bytes:
    """A bit for each shingle in a map of twice to four times as many bits (a power of two, 64 at least)."""
    size = max(64, 1 << (2 * len(sets) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(mix(sets) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def at_most(x: bytes, n: int, y: bytes, m: int) -> int:
    """A sure upper bound of the shingles that two sets of n and m share, from their bit maps."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    # A bit that only one map has stands for at least one shingle that only one set has.
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def scan_sets(docs: DataFrame) -> DataFrame:
    """Step 1: rows (id, text_key, n, sid, bits) of all documents, and rows (token, times) of shingles seen more than once nearby."""

    def flush(kept: list[np.ndarray]) -> pa.RecordBatch | None:
        token, times = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = times > 1
        return _rows(token=token[often].astype(np.int64), times=times[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch, texts in text_chunks(batches):
            names, sizes, maps = [], [], []
            for own in shingle_sets(texts):
                names.append(signature(own) if len(own) else None)
                maps.append(bit_map(own) if len(own) else None)
                sizes.append(len(own))
                kept.append(own)
                held += len(own)
            yield _rows(id=batch.column("id"), text_key=batch.column("text_key"), n=sizes, sid=names, bits=maps)
            if held > COUNTED:
                yield flush(kept)
                kept, held = [], 0
        yield flush(kept)

    def _rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=[*kinds])

    kinds = {**dict.fromkeys(("id", "text_key", "n", "sid", "token", "times"), pa.int64()), "bits": pa.binary()}
    return docs.select("id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, "id long, text_key long, n long, sid long, token long, times long, bits binary").withColumn("row", F.col("token").isNull())


def frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with a level (log2 of their count) and the blocks their list is cut into."""
    counts = scan.filter("not row").groupBy("token").agg(F.sum("times").alias("times"))
    counts = materialize(counts.filter("times >= 4").withColumn("level", F.floor(F.log2("times") * 4).cast("int")), "shingle-counts")
    levels = sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"])  # some hundred rows
    total, least = 0, 1 << 20
    for r in levels:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["level"]
    rows = counts.filter(F.col("level") >= least).select("token", "level", "times").toPandas()  # FREQUENT rows at most
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy(np.int32)[order], (1 + rows["times"].to_numpy(np.int64)[order] // BLOCK)


def prefix_entries(docs: DataFrame, order: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Step 2, first half: (bucket, tokens, groups, sids) with packed arrays.

    A group number holds the size (24 bits) and a hash of the prefix (40 bits).
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level, blocks = shared.value

        def flush(tokens: list[np.ndarray], groups: list[np.ndarray], members: list[tuple[int, int]]) -> pa.RecordBatch:
            token, group = np.concatenate(tokens), np.concatenate(groups)
            if len(often):
                # The list of a very frequent shingle is cut into parts; every two parts meet in a block.
                at = np.minimum(np.searchsorted(often, token), len(often) - 1)
                cut = np.where(often[at] == token, blocks[at], 1)
                more_t, more_g = [token[cut == 1]], [group[cut == 1]]
                for k in np.unique(cut[cut > 1]).tolist():
                    t, g = token[cut == k], group[cut == k]
                    own = mix(g) % np.uint64(k)
                    for other in range(k):
                        low, high = np.minimum(own, np.uint64(other)), np.maximum(own, np.uint64(other))
                        more_t.append(mix(t + low * np.uint64(k) + high + np.uint64(1)))
                        more_g.append(g)
                token, group = np.concatenate(more_t), np.concatenate(more_g)
            pair = np.unique(np.array(members, np.int64).reshape(-1, 2), axis=0)
            to = (token % np.uint64(buckets)).astype(np.int64)
            to_pair = (mix(pair[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            sort, sort_pair = np.argsort(to, kind="stable"), np.argsort(to_pair, kind="stable")
            cuts, cuts_pair = np.searchsorted(to[sort], np.arange(buckets + 1)), np.searchsorted(to_pair[sort_pair], np.arange(buckets + 1))
            token, group, pair = token[sort], group[sort], pair[sort_pair]
            used = [b for b in range(buckets) if cuts[b + 1] > cuts[b] or cuts_pair[b + 1] > cuts_pair[b]]
            pack = lambda x, c: pa.array([x[c[b] : c[b + 1]].tobytes() for b in used], pa.binary())
            return pa.record_batch([pa.array(used, pa.int32()), pack(token, cuts), pack(group, cuts), pack(pair, cuts_pair)], names=["bucket", "tokens", "groups", "members"])

        tokens, groups, members, held, done = [], [], [], 0, set()
        for _, texts in text_chunks(batches):
            for own in shingle_sets(texts):
                n = len(own)
                if not n:
                    continue
                head = n - need(n) + 1
                prefix = own[:head]
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    hot = often[at] == own
                    if hot[:head].any():
                        late = np.flatnonzero(hot)
                        late = late[np.argsort(level[at[late]], kind="stable")]
                        prefix = np.concatenate([own[~hot], own[late]])[:head]
                name = np.bitwise_xor.reduce(mix(prefix)) >> np.uint64(24)
                group = np.uint64(min(n, (1 << 24) - 1) << 40) | name
                pair = (int(np.int64(group)), signature(own))
                if pair in done:
                    continue
                done.add(pair)
                members.append(pair)
                tokens.append(prefix)
                groups.append(np.full(len(prefix), group, np.uint64))
                held += len(prefix)
            if held > COUNTED:
                yield flush(tokens, groups, members)
                tokens, groups, members, held, done = [], [], [], 0, set()
        if members:
            yield flush(tokens, groups, members)

    return docs.mapInArrow(run, "bucket int, tokens binary, groups binary, members binary")


def fits(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough; sizes at the 24-bit limit always can."""
    return (4 * small >= 3 * large) | (large == (1 << 24) - 1)


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    """The distinct rows of two columns, sorted; without the copies that ``np.unique`` makes of whole rows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[fresh]


def list_pairs(token: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups to compare (m, 2), and the (shingle, group) entries of long lists."""
    sort = np.lexsort((group, token))
    token, group = token[sort], group[sort]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group = token[fresh], group[fresh]
    head = np.ones(len(token), bool)
    head[1:] = token[1:] != token[:-1]
    starts = np.flatnonzero(head)
    length = np.diff(np.append(starts, len(token)))
    size = np.repeat(length, length)
    many = size > 1
    token, group, size = token[many], group[many], size[many]
    run = np.cumsum(np.append(True, token[1:] != token[:-1])[: len(token)])
    n = (group >> np.uint64(40)).astype(np.int64)
    pairs = []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        low, high = np.minimum(a, b), np.maximum(a, b)
        ok = (low != high) & fits(low >> np.uint64(40), high >> np.uint64(40))
        pairs.append(distinct_rows(np.column_stack([low[ok], high[ok]])))

    short = np.flatnonzero(size <= SHORT)
    for k in range(1, SHORT):
        left = short[short + k < len(token)]
        left = left[run[left] == run[left + k]]
        take(group[left], group[left + k])
    long = np.flatnonzero(size > SHORT)
    if len(long):
        # Groups are sorted by size within a list: the pivot is the smallest that fits.
        key = run[long] * (1 << 24) + n[long]
        pivot = np.searchsorted(key, run[long] * (1 << 24) + need(n[long]))
        take(group[long][pivot], group[long])
        for seed in (1, 2):
            mixed = long[np.lexsort((mix(group[long] + token[long] * np.uint64(seed)), run[long]))]
            near = run[mixed[1:]] == run[mixed[:-1]]
            take(group[mixed[:-1]][near], group[mixed[1:]][near])
    found = distinct_rows(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.uint64)
    return found, np.column_stack([token[long], group[long]])


def join_lists(entries: DataFrame, buckets: int) -> DataFrame:
    """Step 2, second half: rows (kind, a, b): 0 pair of groups, 1 group and member, 2 long list and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            token, group, pair = (np.concatenate([np.frombuffer(p[k], np.uint64) for p in parts]) for k in range(3))
            found, long = list_pairs(token, group)
            for kind, rows in ((0, found), (1, np.unique(pair.reshape(-1, 2), axis=0)), (2, long)):
                yield pa.record_batch([pa.array(np.full(len(rows), kind), pa.int32()), pa.array(rows[:, 0].astype(np.int64)), pa.array(rows[:, 1].astype(np.int64))], names=["kind", "a", "b"])
            del token, group, pair, found, long
            release()

        last, parts = None, []
        for batch in batches:
            for bucket, *own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "groups", "members"))):
                if bucket != last and parts:
                    yield from close(parts)
                    parts = []
                last = bucket
                parts.append(own)
        if parts:
            yield from close(parts)

    dealt = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "kind int, a long, b long")


def may_link(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names that their bit maps do not rule out."""
    left = names.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x"))
    right = names.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "n1", "y", "n2")))
            keep = [7 * at_most(x, n, y, m) >= 3 * (n + m) for x, n, y, m in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def fetch_sets(docs: DataFrame, readers: DataFrame) -> DataFrame:
    """(sid, body) of the sets whose document may be among ``readers`` (id); body: shortened sorted hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(build(readers.select("id"), readers.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(perhaps(shared.value, batch.column("id").to_numpy(zero_copy_only=False))))
            for _, texts in text_chunks([own]):
                sets = [s for s in shingle_sets(texts) if len(s)]
                body = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]).tobytes() for s in sets]
                yield pa.record_batch([pa.array([signature(s) for s in sets], pa.int64()), pa.array(body, pa.binary())], names=["sid", "body"])

    return docs.mapInArrow(run, "sid long, body binary")


def unpack(body: bytes) -> np.ndarray:
    rows = np.frombuffer(body, np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :KEPT_BYTES] = rows
    return out.view(np.uint64).reshape(-1)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names whose Jaccard similarity is at least 0.75."""
    left = sets.select(F.col("sid").alias("a"), F.col("body").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("body").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a not in known:
                    known = {a: unpack(x.as_py())}
                own, other = known[a], unpack(y.as_py())
                common = overlap(own, other)
                keep.append(4 * common >= 3 * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, text_key.

    Documents link when their sets of five-word shingles (A-Z folded; all words of a
    shorter text as one) have a Jaccard similarity of 0.75 or more; component_id is
    the smallest identifier reachable by links. Null and empty texts have no
    shingles and link with nothing. Repeated rows link like equal texts; rows with a
    null identifier are counted in no component but their own and keep a null
    component_id. An empty table gives an empty result; other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col)
    scan = materialize(scan_sets(base), "shingle-scan")
    rows = scan.filter("row").select("id", "text_key", "n", "sid")
    named = scan.filter("row and sid is not null and id is not null")
    readers = materialize(named.groupBy("sid").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.first("bits").alias("bits")), "set-names")
    total = readers.agg(F.sum(F.col("n") - need_column("n") + 1)).first()[0] or 0
    buckets = max(8, -(-total // ENTRIES))
    order = frequent(scan)
    named_docs = base.filter("id is not null")
    step = materialize(join_lists(prefix_entries(named_docs, order, buckets), buckets), "prefix-join")

    members = step.filter("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("s")).distinct()
    first = members.groupBy("g").agg(F.min("s").alias("pivot"), F.count("*").alias("c"))
    members = materialize(members.join(first, "g"), "group-members")
    # Pairs of groups stand for all pairs of members; a group of many is met through its pivot, and listed.
    groups = step.filter("kind = 0").select("a", "b").distinct()
    left = members.select(F.col("g").alias("a"), F.col("s").alias("s1"), F.col("pivot").alias("p1"), F.col("c").alias("c1"))
    right = members.select(F.col("g").alias("b"), F.col("s").alias("s2"), F.col("pivot").alias("p2"), F.col("c").alias("c2"))
    wide = groups.join(left.filter("c1 = 1 or s1 = p1"), "a").join(right.filter("c2 = 1 or s2 = p2"), "b")
    direct = wide.select("s1", "s2")
    inside = members.filter("s <> pivot").select(F.col("pivot").alias("s1"), F.col("s").alias("s2"))
    crowded = wide.filter("c1 > 1 or c2 > 1").select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("g"))
    lists = step.filter("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("g"))
    lists = lists.unionByName(crowded).unionByName(members.filter("c > 2 and s = pivot").select(F.col("g").alias("list"), "g"))
    lists = materialize(lists.distinct().join(members.select("g", "s"), "g").select("list", "s", F.shiftrightunsigned("g", 40).alias("n")), "long-lists")

    pairs = materialize(may_link(_ordered(direct.unionByName(inside)), readers), "set-pairs")
    sets = materialize(sets_of(named_docs, readers, pairs), "shingle-sets")
    done = links = None
    found = docs.sparkSession.createDataFrame([], "node long, component long")
    rounds = 0
    while True:
        # First one pair for each component, which joins most of them; then all that is left.
        left = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        fresh = materialize(open_pairs(left, found, one_each=rounds < THINNED), "open-pairs")
        rounds += 1
        if fresh.isEmpty():
            if rounds <= THINNED:
                rounds = THINNED
                continue
            break
        found_links = verify(fresh, sets).distinct()
        links = materialize(found_links if links is None else links.unionByName(found_links), "set-links")
        done = fresh if done is None else materialize(done.unionByName(fresh), "pairs-verified")
        found = materialize(components(links), "set-components")
    # Lists are opened only when no known pair can join two components any more.
    stars = materialize(open_in_lists(lists, found, readers, stars=True), "open-in-lists")
    if not stars.isEmpty():
        clusters = components(stars).withColumnRenamed("component", "cluster").withColumnRenamed("node", "component")
        placed = place(lists.select("s").distinct(), found).join(clusters, "component")
        placed = materialize(placed.join(readers.select(F.col("sid").alias("s"), "id", F.col("n").alias("size")), "s"), "clusters")
        sets = materialize(fetch_sets(named_docs, placed.select("id")).dropDuplicates(["sid"]), "cluster-sets")
        found_links = link_clusters(placed, sets)
        links = materialize(found_links if links is None else links.unionByName(found_links), "set-links")
        found = materialize(components(links), "set-components")
    # A component of sets takes the smallest identifier of their documents.
    named = found.join(readers.select(F.col("sid").alias("node"), "id"), "node")
    smallest = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select(F.col("node").alias("sid"), "component_id")
    names = readers.join(smallest, "sid", "left").select("sid", F.coalesce("component_id", "id").alias("component_id"))
    joined = rows.join(names, "sid", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), "text_key")


def need_column(n: str) -> Column:
    return F.floor((3 * F.col(n) + 3) / 4)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).filter("a <> b").distinct()


def open_pairs(pairs: DataFrame, found: DataFrame, one_each: bool) -> DataFrame:
    """The pairs whose members lie in different components; with ``one_each`` one for each component, to a smaller one."""
    left, right = (found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
    known = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")).filter("c_a <> c_b")
    if not one_each:
        return known.select("a", "b")
    if_any = F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("pair")
    return known.groupBy(F.greatest("c_a", "c_b")).agg(if_any).select("pair.a", "pair.b")


def sets_of(docs: DataFrame, readers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shingle sets of all members of ``pairs``."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    return fetch_sets(docs, materialize(readers.join(wanted, "sid", "left_semi").select("id"), "sets-wanted"))


def cross_pairs(names: np.ndarray, n: np.ndarray, component: np.ndarray, part: np.ndarray, maps: list[bytes], within: bool, stars: bool = False) -> Iterator[np.ndarray]:
    """Pairs in different components that neither their sizes nor their bit maps rule out, in batches; of different parts unless ``within``.

    With ``stars`` pairs of components instead, one less than the components that such pairs connect.
    """
    order = np.argsort(n, kind="stable")
    names, n, component, part, maps = names[order], n[order], component[order], part[order], [maps[k] for k in order]
    rows: dict[int, list[int]] = {}
    for k, body in enumerate(maps):
        rows.setdefault(len(body), []).append(k)
    places = {size: np.array(k) for size, k in rows.items()}
    stacked = {size: np.stack([np.frombuffer(maps[k], np.uint64) for k in own]) for size, own in rows.items()}
    out, held = [], 0
    for k, body in enumerate(maps):
        mine = np.frombuffer(body, np.uint64)
        # Sizes are ascending, so a partner's map is as long or twice as long.
        for size in (len(body), 2 * len(body)):
            if size not in places:
                continue
            at = places[size]
            near = np.flatnonzero((at > k) & (component[at] != component[k]) & (within | (part[at] != part[k])) & fits(n[k], n[at]))
            if not len(near):
                continue
            others = stacked[size][near]
            if size > len(body):
                half = others.shape[1] // 2
                others = others[:, :half] | others[:, half:]
            m = n[at[near]]
            most = np.minimum(n[k] - np.bitwise_count(mine & ~others).sum(1), m - np.bitwise_count(others & ~mine).sum(1))
            may = at[near][7 * most >= 3 * (n[k] + m)]
            if stars:
                if len(may):
                    joined = np.unique(np.append(component[may], component[k]))
                    component[np.isin(component, joined)] = joined[0]
                    out.append(np.column_stack([np.full(len(joined) - 1, joined[0]), joined[1:]]))
                    held += len(joined) - 1
                continue
            out.append(np.column_stack([np.minimum(names[k], names[may]), np.maximum(names[k], names[may])]))
            held += len(may)
        if held >= EMITTED:
            yield np.concatenate(out)
            out, held = [], 0
    if held:
        yield np.concatenate(out)


def deal_lists(placed: DataFrame) -> DataFrame:
    """The rows of lists that lie in several components, once for each pair (low, high) of parts they are compared in."""
    kinds = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"))
    mixed = kinds.filter("low <> high").select("list", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    rows = placed.join(mixed, "list").withColumn("part", F.pmod(F.xxhash64(F.lit(7), "s"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("list", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "s", "component")


def place(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (s) with their component, which is their own name where no link was found."""
    return members.join(found.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s"))


def open_in_lists(lists: DataFrame, found: DataFrame, names: DataFrame, stars: bool = False) -> DataFrame:
    """Pairs of a long list in different components that may link; a task compares two parts of a list.

    With ``stars`` the components that may link by such pairs: (a, b) connects all of them, in rows that
    a task makes fewer of than it has components.
    """
    placed = deal_lists(place(lists, found)).join(names.select(F.col("sid").alias("s"), F.col("n").alias("size"), "bits"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            name, size, component, part, maps = zip(*rows)
            for pairs in cross_pairs(*(np.array(x, np.int64) for x in (name, size, component, part)), list(maps), key[1] == key[2], stars):
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        last, rows = None, []
        for batch in batches:
            for *key, name, size, component, part, bits in zip(*(batch.column(c).to_pylist() for c in ("list", "low", "high", "s", "size", "component", "part", "bits"))):
                if key != last and rows:
                    yield from close(last, rows)
                    rows = []
                last = key
                rows.append((name, size, component, part, bits))
        if rows:
            yield from close(last, rows)

    dealt = placed.select("list", "low", "high", "s", "size", "component", "part", "bits").repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def deal_clusters(placed: DataFrame) -> DataFrame:
    """The members of clusters (s, component, cluster, size), once for each block (cluster, x, y) they are compared in.

    The largest component of a cluster that fills several parts meets the parts of the others only.
    """
    weight = lambda: (F.count("*").alias("c"), F.sum("size").alias("w"))
    parts = lambda c, w: F.greatest(F.ceil(c / PART), F.ceil(w / WEIGHT), F.lit(1)).cast("int")
    kinds = placed.groupBy("cluster", "component").agg(*weight())
    all_of = kinds.groupBy("cluster").agg(F.sum("c").alias("c_all"), F.sum("w").alias("w_all"), F.max(F.struct("w", "c", "component")).alias("top"))
    all_of = all_of.withColumn("one", parts(F.col("c_all"), F.col("w_all")) == 1)
    all_of = all_of.withColumn("main", F.when(~F.col("one"), F.col("top.component")))
    all_of = all_of.withColumn("mains", F.when(F.col("one"), 0).otherwise(parts(F.col("top.c"), F.col("top.w"))))
    all_of = all_of.withColumn("others", F.when(F.col("one"), 1).otherwise(parts(F.col("c_all") - F.col("top.c"), F.col("w_all") - F.col("top.w"))))
    rows = placed.join(all_of.select("cluster", "main", "mains", "others"), "cluster").withColumn("is_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "s"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))))
    # Blocks of two parts of the others have y >= 0, blocks with a part of the main component -1 - its number.
    x = F.when(F.col("is_main"), F.col("other")).when(F.col("other") < 0, F.col("part")).otherwise(F.least("part", "other"))
    y = F.when(F.col("is_main"), -1 - F.col("part")).when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("part", "other"))
    return rows.select("cluster", x.alias("x"), y.alias("y"), "s", "component")


def joining_links(names: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Similar pairs that join the components of some sets, one less than the components each joins."""
    size = np.array([len(s) for s in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, value, times = np.unique(value, return_inverse=True, return_counts=True)
    postings, starts = owner[np.argsort(value, kind="stable")], np.cumsum(times) - times
    ends = np.cumsum(size)
    label, out = np.unique(component, return_inverse=True)[1], []
    # Pairs inside the largest component need no look, those with it are met from the other side.
    for k in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        own = value[ends[k] - size[k] : ends[k]]
        own = own[times[own] > 1]
        if not len(own):
            continue
        length = times[own]
        at = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(postings[at], minlength=len(sets))
        linked = np.flatnonzero((4 * common >= 3 * (size + size[k] - common)) & (label != label[k]))
        if len(linked):
            labels, first = np.unique(label[linked], return_index=True)
            other = names[linked[first]]
            out.append(np.column_stack([np.minimum(names[k], other), np.maximum(names[k], other)]))
            label[np.isin(label, labels)] = label[k]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def link_clusters(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of clusters; a task compares the sets of two parts of a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            names, component, bodies = zip(*rows)
            links = joining_links(np.array(names, np.int64), np.array(component, np.int64), [unpack(body) for body in bodies])
            if len(links):
                yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        last, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y")))
            for key, name, component, body in zip(keys, batch.column("s").to_pylist(), batch.column("component").to_pylist(), batch.column("body")):
                if key != last and rows:
                    yield from close(rows)
                    rows = []
                last = key
                rows.append((name, component, body.as_py()))
        if rows:
            yield from close(rows)
        release()

    dealt = deal_clusters(placed).join(sets.withColumnRenamed("sid", "s"), "s")
    dealt = dealt.select("cluster", "x", "y", "s", "component", "body").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()
