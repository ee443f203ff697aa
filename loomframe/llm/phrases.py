"""Phrase collocations, mined by sampling with a negative border.

A sample of the documents proposes phrases. One pass over all documents counts exactly,
for each language, every word and every longer phrase whose two parts (all but its last
word, all but its first) were both proposed: those phrases are the proposals and their
negative border. A phrase of the border that turns out frequent was missed by the sample;
then a further pass counts the phrases whose parts are frequent by now and that no pass
has counted yet, until a pass finds nothing that could be a part of more. As a phrase is
never more frequent than its parts, every frequent phrase is then counted exactly.

Which phrases a pass counts is decided by a membership filter of bounded size over the
parts. It never says no to a part, and what it lets through beyond them is counted in
whole as well. The passes count by keys of 64 bits; the texts of what may be frequent are
counted at the end, so counts are exact whatever the filter and the keys do.

Null texts count as empty, null languages as ``und``; repeated rows count each time, and
identifiers, null or not, only help to draw the sample. Texts of any length are read whole, in slices of a few megabytes.
An empty table gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.llm.bytewords import FOLD, mix, text_bytes, text_chunks, tokens
from loomframe.llm.membership import build, perhaps
from loomframe.session import materialize

#: Characters that end a piece, and those between the words of a piece.
STOPS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Words of the longest phrase.
LONGEST = 4
#: One document in so many is in the sample.
SAMPLE = 8
#: Bytes of text whose phrases are counted together before they leave a worker.
SLICE_BYTES = 2 << 20
#: Rows that one task ranks at most, before it passes on its best.
RANK_ROWS = 100_000
#: floor(2,000,000 * a / (l + r)); products may pass 64 bits.
SCORE = "cast(2000000 * cast(a as decimal(30, 0)) div cast(l + r as decimal(30, 0)) as long)"

_WORDS = np.ones(256, np.uint8)
_WORDS[list(STOPS + SPACES)] = 0
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_PLACES = mix(np.arange(101, 101 + LONGEST, dtype=np.uint64)) | np.uint64(1)
COUNTS = "lang string, phrase string, size int, n long"


class _Filters:
    """Which parts of phrases this pass and the earlier ones let through; without any, all."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits

    def __len__(self) -> int:
        return max(1, len(self.bits))

    def let(self, keys: np.ndarray) -> np.ndarray:
        """A row for each filter, the latest first."""
        if not self.bits:
            return np.ones((1, len(keys)), bool)
        return np.array([perhaps(bits, keys.view(np.int64)) for bits in self.bits[::-1]])


def _number(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values under one number, and a place where each number occurs."""
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    code = np.empty(len(values), np.int64)
    code[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    return code, head


def _pieces(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The given runs of ``data`` as strings."""
    ends = np.cumsum(size)
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    places = np.arange(ends[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])]).cast(pa.string())


def _single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends."""
    size = ends - starts + 1
    to = np.cumsum(size)
    out = data[np.minimum(np.arange(to[-1]) + np.repeat(starts - to + size, size), len(data) - 1)]
    out[to - 1] = 0x20
    return out, to - size, to - 1


def _names(values: list[str]) -> np.ndarray:
    """64 bits that name each value."""
    hashes, _, _, bounds = tokens(pa.array(values, pa.large_string()), np.ones(256, np.uint8))
    out = np.zeros(len(values), np.uint64)
    full = np.flatnonzero(np.diff(bounds))  # the empty name has no token
    out[full] = hashes[bounds[full]]
    return out


def _keys(words: np.ndarray, first: np.ndarray, size: int, lang: np.ndarray) -> np.ndarray:
    """64 bits that name the phrases of ``size`` words that begin at ``first``; the last two hold the size, less one."""
    total = lang + np.uint64(size)
    for k in range(size):
        total = total + words[first + k] * _PLACES[k]
    return (mix(total) & ~np.uint64(3)) | np.uint64(size - 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each slice of text: languages, folded bytes, words, their language, and which are followed in their piece."""
    for part, texts in text_chunks(batches, SLICE_BYTES):
        hashes, starts, ends, bounds = tokens(texts, _WORDS, FOLD, relative=False)
        if len(hashes):
            data = FOLD[text_bytes(texts)]
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            text = np.repeat(np.arange(len(langs)), np.diff(bounds))
            lang = np.array([names.index(x) for x in langs])[text]
            piece = np.cumsum(_STOP[data])[starts]
            follows = np.append((text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), False)
            yield names, data, (hashes, starts, ends), lang, follows


def _levels(hashes: np.ndarray, lang_key: np.ndarray, follows: np.ndarray, filters: _Filters, longest: int) -> Iterator[tuple]:
    """For each size the places of the phrases whose parts the latest filter lets through.

    With each place come the phrase's key, whether each filter lets the parts through
    (a row a filter), and whether it lets the phrase itself through.
    """
    whole = np.ones(len(hashes), bool)
    let = np.ones((len(filters), len(hashes)), bool)
    for size in range(1, longest + 1):
        place = np.flatnonzero(let[0])
        if not len(place):
            return
        keys = _keys(hashes, place, size, lang_key[place])
        member = filters.let(keys) & let[:, place]
        yield size, place, keys, let[:, place], member
        here = np.zeros_like(let)
        here[:, place] = member
        whole = np.append(whole[:-1] & whole[1:], False) & follows
        let = here & np.append(here[:, 1:], np.zeros((len(here), 1), bool), axis=1) & whole


def count_keys(batches: Iterator[pa.RecordBatch], filters: _Filters, longest: int) -> Iterator[pa.RecordBatch]:
    """Keys of phrases with their counts in a slice of text.

    The first pass counts every word. A longer phrase is counted where this pass's
    filter lets both its parts through, and no earlier filter did.
    """
    for names, _, (hashes, _, _), lang, follows in _slices(batches):
        found = []
        for size, _, keys, let, _ in _levels(hashes, _names(names)[lang], follows, filters, longest):
            if size > 1 or len(filters) == 1:
                found.append(keys if size == 1 else keys[~let[1:].any(axis=0)])
        if found:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def count_phrases(batches: Iterator[pa.RecordBatch], frequent: _Filters, longest: int) -> Iterator[pa.RecordBatch]:
    """Phrases whose keys may be frequent, with their texts and counts in a slice (COUNTS).

    Words are numbered by language, a phrase by the number of all but its last word and
    that of its last word, so a slice never mixes two phrases up. A row without a phrase
    holds the number of words of a language.
    """
    for names, data, (hashes, starts, ends), lang, follows in _slices(batches):
        spaced, at, to = _single_spaced(data, starts, ends)
        totals = np.bincount(lang, minlength=len(names))
        yield pa.record_batch([pa.array(names), pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array(totals)], names=["lang", "phrase", "size", "n"])
        one = _number(_number(hashes.view(np.int64))[0] * len(names) + lang)[0]
        n_one = int(one.max()) + 1
        code = one.copy()
        for size, place, _, _, member in _levels(hashes, _names(names)[lang], follows, frequent, longest):
            place = place[member[0]]
            if not len(place):
                break
            number, head = _number(code[place] * n_one + one[place + size - 1] if size > 1 else one[place])
            if size > 1:
                code[place] = number
            begin = place[head]
            phrase = _pieces(spaced, at[begin], to[begin + size - 1] - at[begin])
            yield pa.record_batch([pa.array(names).take(pa.array(lang[begin])), phrase, pa.array(np.full(len(begin), size, np.int32)), pa.array(np.bincount(number))], names=["lang", "phrase", "size", "n"])


def _count(docs: DataFrame, filters: list[np.ndarray], longest: int, least: int) -> DataFrame:
    """Keys of phrases counted by one pass, as far as they occur ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    run = lambda batches: count_keys(batches, _Filters(shared.value), longest)
    counts = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return materialize(counts.filter(F.col("n") >= least).select("key"), f"phrase-keys-{len(filters)}")


def _any_outside(keys: DataFrame, bits: np.ndarray) -> bool:
    """Whether the filter surely lacks one of the keys."""
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~perhaps(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return not keys.mapInArrow(run, "key long").isEmpty()


def frequent_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, sample: int = SAMPLE
) -> tuple[DataFrame, int]:
    """All phrases that occur ``least`` times in a language (COUNTS) and the number of passes.

    Rows without a phrase hold the number of words of a language. One document in
    ``sample`` proposes what it holds ``least / (2 * sample)`` times, at least twice.
    The passes count by keys of 64 bits, which may take two phrases for one but never
    lose one; a last pass counts the texts of all that may be frequent.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases of 1 to {LONGEST} words can be counted")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(sample)) == 0).select("lang", "text")
    rows = rows.select("lang", "text")
    is_part = F.col("key").bitwiseAND(3) < longest - 1  # the last two bits hold the size, less one
    parts = _count(drawn, [], longest - 1, max(2, least // (2 * sample))) if longest > 1 else rows.sparkSession.createDataFrame([], "key long")
    found, filters, passes = None, [], 0
    while True:
        filters = [*filters, build(parts, parts.count())]
        counted = _count(rows, filters, longest, least)
        found = counted if found is None else found.unionByName(counted)
        passes += 1
        # the border that fails: parts found frequent that the filter was not made of
        parts = found.filter(is_part)
        if not _any_outside(parts, filters[-1]):
            break
    shared = docs.sparkSession.sparkContext.broadcast([build(found, found.count())])
    run = lambda batches: count_phrases(batches, _Filters(shared.value), longest)
    counts = rows.mapInArrow(run, COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return materialize(counts.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases"), passes


def _best(rows: DataFrame, group: str, order: list[Column], top: int, spread_by: list[str]) -> DataFrame:
    """The first ``top`` rows of each group with their rank; a large group is ranked in parts first."""
    room = max(RANK_ROWS, 2 * top)
    parts = math.ceil(rows.count() / room)
    while parts > 1:
        part = F.pmod(F.xxhash64(*spread_by), F.lit(parts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, part).orderBy(*order))).filter(F.col("rank") <= top)
        parts = parts * top // room
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: int = 30, longest: int = LONGEST, covered: int = 80, top: int = 2_000, sample: int = SAMPLE,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its two sides at the cut
    with the lowest score (of equal ones the first), ``n`` the words of the language. A
    phrase inside a longer frequent one with at least ``covered`` percent of its count
    is left out.
    """
    found, _ = frequent_phrases(docs, id_col, text_col, lang_col, least, longest, sample)
    words = found.filter("phrase is null").select("lang", "n")
    counts = found.filter("phrase is not null")
    phrases = counts.filter("size > 1").withColumnRenamed("n", "a")
    # a longer phrase is no more frequent than those of one word less inside it, so these decide
    inner = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    hidden = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(hidden, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    sides = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    scored = lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = _best(materialize(scored, "phrase-scores"), "lang", order, top, ["phrase"])
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
