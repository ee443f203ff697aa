"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The pieces are cut and counted in one Arrow pass. The plan is made on the
histogram of piece lengths, which has at most ``capacity`` rows however large
the table is; each piece then finds its place from its length and its rank among
the pieces of that length, by one join with the plan.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loomframe.llm.bytewords import FOLD, release, text_bytes, text_chunks, tokens
from loomframe.llm.common import id_and_text
from loomframe.session import materialize

#: Rows of the rank table that may be sent to every executor (some 100 MB).
SENT_ROWS = 2_000_000
#: Words remembered by a Python worker within a task, and the least slots of their table.
WORD_CACHE, SLOTS = 1_000_000, 1 << 18
#: Bytes of text encoded at once.
ENCODED_BYTES = 1 << 19

# Byte classes for cutting words into parts that are encoded on their own: 1 letters
# and digits, 2 ASCII symbols, 3 anything that makes the whole word stay in one part
# (the apostrophe of contractions, and characters that normalisation might join).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[33:127] = 2
_CLASS[[b for b in range(128) if chr(b).isalnum()]] = 1
_CLASS[ord("'")] = 3


def part_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; two-byte letters U+00C0 to U+017F count as letters."""
    kind = _CLASS[data]
    lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    pair = data[:-1].astype(np.uint16) * 256 + data[1:]
    lead &= (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)  # no letters, and one that lower-cases to two
    at = np.flatnonzero(lead)
    kind[at] = 1
    kind[at + 1] = 1
    odd = np.flatnonzero(kind == 3)
    if len(odd):
        gaps = np.flatnonzero(kind == 0)
        k = np.searchsorted(gaps, odd)
        edges = np.concatenate([[-1], gaps, [len(data)]])
        whole = np.zeros(len(data) + 1, np.int32)
        k = np.unique(k)
        whole[edges[k] + 1] += 1
        whole[edges[k + 1]] -= 1
        kind[np.cumsum(whole[:-1]) > 0] = 3
    return kind


class WordEncoder:
    """Token ids of texts, each distinct part of a word encoded once by the tokenizer.

    Valid for tokenizers that lower-case, drop white space, and cut between letters
    and symbols. Parts are told apart by 64-bit hashes.
    """

    #: White space around it makes it a token of its own, so it separates parts that are encoded together.
    MARK = "|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.raw(self.MARK)
        self.clear()

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.spots = np.full(SLOTS, -1, np.int32)
        self.ids = np.zeros(1 << 16, "<u4")
        self.starts = np.zeros(1 << 16, np.int64)
        self.known = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is new."""
        last = len(self.keys) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        place = self.spots[slot]
        open_ = np.flatnonzero((place >= 0) & (self.keys[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            place[open_] = self.spots[slot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.keys[slot[open_]] != hashes[open_])]
        return place

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode distinct new parts and remember them."""
        plain = [w for w in words if self.MARK not in w]
        joined = np.array(self.raw(f" {self.MARK} ".join(plain)), "<u4") if plain else np.zeros(0, "<u4")
        cuts = np.concatenate([[-1], np.flatnonzero(joined == self.mark), [len(joined)]])
        body = iter([joined[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:])])
        lists = [next(body) if self.MARK not in w else np.array(self.raw(w), "<u4") for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        fresh = np.concatenate(lists)
        while self.used + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(fresh)] = fresh
        self.starts[self.known + 1 : self.known + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(fresh)
        self.grow(self.known + len(words))
        self.insert(hashes, self.known + np.arange(len(words)))
        self.known += len(words)

    def grow(self, words: int) -> None:
        """Room for ``words`` at half load, so that free slots remain however many parts one text has."""
        size = len(self.keys)
        while size < 2 * words:
            size *= 2
        if size > len(self.keys):
            held = np.flatnonzero(self.spots >= 0)
            keys, places = self.keys[held], self.spots[held]
            self.keys = np.zeros(size, np.uint64)
            self.spots = np.full(size, -1, np.int32)
            self.insert(keys, places)

    def insert(self, hashes: np.ndarray, places: np.ndarray) -> None:
        last = len(self.keys) - 1
        slot = (hashes & np.uint64(last)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.spots[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]] = hashes[won]
            self.spots[slot[won]] = places[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry at the end)."""
        hashes, first, end, bounds = tokens(texts, part_classes, FOLD, relative=False)
        place = self.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.known + len(new) > WORD_CACHE:
                self.clear()
                new = np.arange(len(hashes))
            data = text_bytes(texts).tobytes()
            fresh, where = np.unique(hashes[new], return_index=True)
            for at in range(0, len(fresh), 50_000):
                spans = zip(first[new[where[at : at + 50_000]]].tolist(), end[new[where[at : at + 50_000]]].tolist())
                self.add(fresh[at : at + 50_000], [data[a:b].decode("utf-8", "replace") for a, b in spans])
            place = self.find(hashes)
        begin = self.starts[place]
        size = self.starts[place + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        bounds = total[bounds]
        return self.with_specials(texts, ids, bounds)

    def with_specials(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that spell out a special token are encoded whole."""
        odd = np.zeros(len(texts), bool)
        for special in self.specials:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, bounds
        rows = [np.array(self.raw(texts[k].as_py()), "<u4") if odd[k] else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept from task to task without its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces: id, piece, start, length, ids_crc32, ids, part, nth.

    A document is its ids and ``end_id``; only longer ones are cut. ``nth`` counts the
    pieces of equal length in partition ``part``. ``ids`` holds unsigned 32-bit
    little-endian ids and is null unless ``with_ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for batch, texts in text_chunks(batches, ENCODED_BYTES):
            ids, bounds = coder.encode(texts)
            out: list[list] = [[] for _ in range(8)]
            for key, lo, hi in zip(batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    body = own[start : start + capacity].tobytes()
                    length = len(body) // 4
                    for column, value in zip(out, (key, piece, start, length, zlib.crc32(body), body if with_ids else None, part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])
        coder.clear()
        release()

    schema = "id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, nth long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


Segment = tuple[int, int, int, int, int, int]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Places for ``counts[length]`` pieces of each length, and the number of bins.

    A segment (length, from, to, first_bin, each, offset) says: pieces ``from`` to
    ``to`` of that length go to consecutive bins, ``each`` to a bin, from ``offset`` on.
    Bins that hold the same lengths are handled as one, so the plan's size
    follows the number of lengths, not the number of pieces.

    Pieces above a third of the capacity come two to a bin at most: the largest is
    matched with the largest that still fits. The smaller ones then go, largest
    first, where they leave the smallest gap; what fits nowhere opens bins.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    segments: list[Segment] = []
    gaps: list[tuple[int, int, int]] = []  # (free, first bin, bins), ordered
    bins = 0

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        segments.append((length, taken[length], taken[length] + pieces, first, each, offset))
        taken[length] += pieces
        left[length] -= pieces

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        if not left[top]:
            large.pop()
            continue
        at = bisect_left(large, capacity - top + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        mate = large[at] if at >= 0 else None
        if mate == top and left[top] < 2:
            mate = large[at - 1] if at > 0 and left[large[at - 1]] else None
        if mate is None:
            n = left[top]
            put(top, n, bins, 1, 0)
            free = capacity - top
        elif mate == top:
            n = left[top] // 2
            put(top, 2 * n, bins, 2, 0)
            free = capacity - 2 * top
        else:
            n = min(left[top], left[mate])
            put(top, n, bins, 1, 0)
            put(mate, n, bins, 1, top)
            free = capacity - top - mate
        insort(gaps, (free, bins, n))
        bins += n

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                n = max(1, left[length] // (capacity // length))
                gaps.append((capacity, bins, n))
                bins += n
            free, first, n = gaps.pop(at)
            each = min(free // length, left[length])
            use = min(n, left[length] // each)
            put(length, use * each, first, each, capacity - free)
            insort(gaps, (free - each * length, first, use))
            if n > use:
                insort(gaps, (free, first + use, n - use))
    return segments, bins


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with length, part, nth; written, so that they stay as they are) with sequence_id and offset."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = materialize(sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n"), "pieces-before")
    # A row for each length and partition: sent to all tasks while it is small, else the pieces are dealt to it.
    before = F.broadcast(before) if before.count() <= SENT_ROWS else before
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    segments, _ = plan_bins(counts, capacity)
    plan = spark.createDataFrame(segments or [(0, 0, 0, 0, 1, 0)], "length int, low long, high long, first long, each long, base long")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan has a few rows for each of the at most `capacity` lengths.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["high"])).drop(plan["length"])
    nth = F.col("rank") - F.col("low")
    return placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each"))).withColumn("offset", F.col("base") + (nth % F.col("each")) * F.col("length"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces with their place: id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null text counts as empty (one ``end_id``); repeated rows and null identifiers
    are documents of their own; an empty table gives an empty result; other columns
    are not read. Every sequence is filled from 0 without gaps.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "token-pieces")
    return place(pieces, capacity).select("id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "ids", "sequence_id", "offset")


def default_tokenizer() -> str:
    """Where the word tokenizer lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


