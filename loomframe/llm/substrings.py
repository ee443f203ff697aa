"""Removal of long repeats that an earlier document holds, through fixed-block anchors.

A window of WINDOW words covers a whole block of BLOCK words of any text it occurs
in, wherever that text's non-overlapping blocks begin. So:

1. index the blocks of every document (a membership filter spares probes that
   surely match none);
2. probe with every rolling block; hashes that two different texts hold, one of
   them as a block, are anchors;
3. extend: every window that covers an anchor is compared across documents by its own
   hash; neighbouring windows together make the maximal repeats;
4. cut the words that a window from a smaller identifier covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.bytewords import PLAIN, mix, text_chunks, tokens
from loomframe.llm.common import id_and_text
from loomframe.llm.membership import build, perhaps
from loomframe.llm.shingles import window_hashes
from loomframe.session import materialize

#: Words of a window, and of a block: any window holds a whole block if 2 * BLOCK - 1 <= WINDOW.
WINDOW, BLOCK = 50, 25
#: Bits of a text's hash that stand beside a position, to tell rows of one identifier apart.
TAG_BITS, PLACE_BITS = 20, 40


def _within(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether a run of ``width`` words starting at each of ``n`` places stays in its text."""
    inside = np.zeros(n, bool)
    last = bounds[1:] - width + 1
    for lo, hi in zip(bounds[:-1][last > bounds[:-1]].tolist(), last[last > bounds[:-1]].tolist()):
        inside[lo:hi] = True
    return inside


def _signatures(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scan_texts(docs: DataFrame) -> DataFrame:
    """id, n, sig, whole_sha256, blocks (packed hashes of the non-overlapping blocks of texts that hold a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words, _, _, bounds = tokens(texts, PLAIN)
            rolling = window_hashes(words, BLOCK)
            n = np.diff(bounds)
            blocks = [rolling[lo : hi - BLOCK + 1 : BLOCK].tobytes() if hi - lo >= WINDOW else None for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            sha = [_digest(t.encode().split()) for t in texts.to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(_signatures(words, bounds), pa.int64()), pa.array(sha), pa.array(blocks, pa.binary())], names=["id", "n", "sig", "whole_sha256", "blocks"])

    return docs.mapInArrow(run, "id long, n long, sig long, whole_sha256 string, blocks binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """The block hashes as rows of one long column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(batch.column("blocks").to_pylist()), np.int64))], names=["hash"])

    return rows.filter("blocks is not null").select("blocks").mapInArrow(run, "hash long")


def probe(docs: DataFrame, blocks: np.ndarray) -> DataFrame:
    """(hash, sig, block) of every rolling block that may be indexed, once for each text of a chunk; block: it lies on the grid."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            words, _, _, bounds = tokens(texts, PLAIN)
            rolling = window_hashes(words, BLOCK)
            at = np.flatnonzero(_within(bounds, BLOCK, len(rolling)))
            at = at[perhaps(shared.value, rolling[at].astype(np.int64))]
            doc = np.searchsorted(bounds, at, "right") - 1
            long = np.diff(bounds)[doc] >= WINDOW
            at, doc = at[long], doc[long]
            grid = (at - bounds[doc]) % BLOCK == 0
            rows = np.column_stack([rolling[at].astype(np.int64), _signatures(words, bounds)[doc], grid.astype(np.int64)])
            rows = np.unique(rows, axis=0)
            yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(bool))], names=["hash", "sig", "block"])

    return docs.mapInArrow(run, "hash long, sig long, block boolean")


def covering_windows(docs: DataFrame, anchors: np.ndarray) -> DataFrame:
    """(window, id, place) of the windows that cover a hash of the filter; place holds the tag and the first word."""
    shared = docs.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words, _, _, bounds = tokens(texts, PLAIN)
            rolling = window_hashes(words, BLOCK)
            inside = _within(bounds, BLOCK, len(rolling))
            hit = np.flatnonzero(inside & perhaps(shared.value, rolling.astype(np.int64)))
            mark = np.zeros(len(words) + 1, np.int32)
            first = bounds[np.searchsorted(bounds, hit, "right") - 1]
            np.add.at(mark, np.maximum(hit - (WINDOW - BLOCK), first), 1)
            np.add.at(mark, hit + 1, -1)
            windows = window_hashes(words, WINDOW)
            at = np.flatnonzero((np.cumsum(mark)[: len(windows)] > 0) & _within(bounds, WINDOW, len(windows)))
            doc = np.searchsorted(bounds, at, "right") - 1
            tag = _signatures(words, bounds)[doc] & ((1 << TAG_BITS) - 1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[doc]
            yield pa.record_batch([pa.array(windows[at].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array((tag << PLACE_BITS) | (at - bounds[doc]))], names=["window", "id", "place"])

    return docs.mapInArrow(run, "window long, id long, place long")


def cut(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(id, tag, n_removed, kept) of the documents in ``repeats`` (id, tag, places); kept: the words left, joined by one space."""
    shared = docs.sparkSession.sparkContext.broadcast(build(repeats.select("id"), repeats.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(perhaps(shared.value, batch.column("id").to_numpy(zero_copy_only=False))))
            for chunk, texts in text_chunks([own]):
                words, _, _, bounds = tokens(texts, PLAIN)
                yield pa.record_batch([chunk.column("id"), pa.array(_signatures(words, bounds) & ((1 << TAG_BITS) - 1)), texts.cast(pa.string())], names=["id", "tag", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places")):
                words = text.encode().split()
                mark = np.zeros(len(words) + 1, np.int64)
                first = np.asarray(places.values)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + WINDOW, -1)
                gone = np.cumsum(mark)[:-1] > 0
                out.append((int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)))
            yield pa.record_batch([batch.column("id"), batch.column("tag"), pa.array([n for n, _ in out], pa.int64()), pa.array([k.decode() for _, k in out])], names=["id", "tag", "n_removed", "kept"])

    picked = docs.mapInArrow(pick, "id long, tag long, text string")
    return picked.join(repeats, ["id", "tag"]).select("id", "tag", "text", "places").mapInArrow(run, "id long, tag long, n_removed long, kept string").dropDuplicates(["id", "tag"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, kept (null where nothing was removed).

    A word goes if a run of 50 words that covers it also starts in a document with a
    smaller identifier; runs are judged on the input. Repeats inside one document
    stay. Null and empty texts have no words. Rows that repeat an identifier are not
    smaller than each other; a null identifier neither removes nor loses words. An
    empty table gives an empty result; other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col)
    rows = materialize(scan_texts(base), "word-scan")
    named = base.filter("id is not null")
    # Of texts with equal words the smallest identifier stays; the others lose every word.
    firsts = materialize(rows.filter("id is not null").groupBy("sig").agg(F.min("id").alias("first"), F.first("n").alias("n")), "word-sequences")
    n_blocks = firsts.filter(F.col("n") >= WINDOW).agg(F.sum(F.floor(F.col("n") / BLOCK))).first()[0] or 0
    seen = probe(named, build(unpacked(rows), n_blocks)).groupBy("hash").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.max("block").alias("block"))
    anchors = materialize(seen.filter("low <> high and block").select("hash"), "anchors")
    windows = materialize(covering_windows(named, build(anchors, anchors.count())), "windows")
    shared = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("window", "low")
    late = windows.join(shared, "window").filter("id > low").select("id", F.shiftrightunsigned("place", PLACE_BITS).alias("tag"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"))
    whole = rows.join(firsts.select("sig", "first"), "sig").filter((F.col("id") > F.col("first")) & (F.col("n") >= WINDOW)).select("id", F.col("sig").bitwiseAND((1 << TAG_BITS) - 1).alias("tag"))
    repeats = materialize(late.groupBy("id", "tag").agg(F.collect_list("place").alias("places")).join(whole, ["id", "tag"], "left_anti"), "repeats")
    done = materialize(cut(named, repeats), "cut-texts").unionByName(whole.distinct().select("id", "tag", F.lit(None).cast("long").alias("n_removed"), F.lit("").alias("kept")))
    tagged = rows.withColumn("tag", F.col("sig").bitwiseAND((1 << TAG_BITS) - 1))
    out = tagged.join(done, ["id", "tag"], "left")
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.coalesce("n_removed", "n"))
    return out.select("id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"), "kept")
