"""SentencePiece encoding and decoding with a forward pass shared between words.

Spaces become the mark that starts a word. The distinct marked words of a batch are
sorted, which lays them out as a trie in depth-first order: a word keeps the forward
states of the prefix that it shares with the word before and computes only the rest.

The vocabulary is of the merge kind, whose segmentation of a prefix is unique: the
best path to a place ends in the one piece that is compatible with the best path to
its own start. That last piece is the forward state of a place, and the Viterbi step
looks for it among the pieces that end there, longest first. Ids equal those of the
library that the vocabulary file belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomframe.llm.bytewords import text_bytes, text_chunks
from loomframe.llm.common import id_and_text

MARK = "▁"
#: Words that a Python worker remembers.
WORD_CACHE = 400_000
#: Id lists that a task decodes at a time.
ID_ROWS = 200


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's words start (one more entry at the end).

    A text begins with a mark, and its spaces are marks. A word is a run of marks with
    what follows them; line breaks stand alone. The vocabulary has no piece with a mark
    behind another character, nor one with a line break.
    """
    full = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), pc.replace_substring(texts, " ", MARK), pa.scalar("", pa.large_string()))
    full = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), full)
    data = text_bytes(full)
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    offsets = offsets - offsets[0]
    first, second, third = MARK.encode("utf-8")
    mark = np.zeros(len(data) + 3, bool)  # mark[i + 3]: a mark begins at byte i
    if len(data) > 2:
        mark[3:-2] = (data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third)
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = mark[3:] & ~mark[:-3]
    line = np.flatnonzero(data == 10)
    cut[line] = True
    cut[line + 1] = True
    cut[offsets] = True  # also the end of the last text
    starts = np.flatnonzero(cut)
    words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data))
    return words, np.searchsorted(starts, offsets)


class PieceModel:
    """Pieces of a model file, and the words encoded so far."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
        self.bytes = {}
        self.ids = {}
        self.rank = {}
        for k, piece in enumerate(self.pieces):
            if processor.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k)):
                self.ids[piece] = k
                self.rank[piece] = -processor.get_score(k)
        self.unknown = processor.unk_id()
        # What each id stands for; control pieces stand for nothing.
        self.values = [p.encode("utf-8") if p in self.ids else b"" for p in self.pieces]
        for b, k in self.bytes.items():
            self.values[k] = bytes([b])
        self.table = pa.array(self.values, pa.large_binary())
        # Nothing merges across two neighbours that no piece holds side by side.
        self.neighbours = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        # Pieces that their own characters merge into; no others occur.
        self.whole = {piece for piece in self.ids if len(piece) > 1 and self.merge(piece) == [piece]}
        # How long the pieces are that end in two characters, longest first.
        self.lengths: dict[str, list[int]] = {}
        for pair, size in sorted({(piece[-2:], -len(piece)) for piece in self.whole}):
            self.lengths.setdefault(pair, []).append(-size)
        self.compatible: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        """No words: ``words`` gives a word's place, ``store`` all ids and where those of each place start."""
        self.words: dict[str, int] = {}
        self.store = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode new words, those units of them first that were not met before."""
        cuts = [self.cut(w) for w in new]
        units = self.units
        self.encode_sorted(sorted({u for one in cuts for u in one if u not in units}))
        ids, sizes = [], np.zeros(len(new), np.int64)
        for k, one in enumerate(cuts):
            before = len(ids)
            for u in one:
                ids += units[u]
            sizes[k] = len(ids) - before
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        flat, starts = self.store
        self.store = np.concatenate([flat, np.array(ids, np.int32)]), np.concatenate([starts, starts[-1] + np.cumsum(sizes)])

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by its definition: the best adjacent pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.rank.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are side by side."""
        key = (left, right)
        if key not in self.compatible:
            self.compatible[key] = self.merge(left + right) == [left, right]
        return self.compatible[key]

    def encode_sorted(self, units: list[str]) -> None:
        """Encode sorted distinct units, each from the state of the prefix it shares with the one before."""
        last: list[str] = [""]  # last[i]: the piece that ends the best path to place i
        before, whole, lengths, known, single = "", self.whole, self.lengths, self.compatible, self.ids.get
        for unit in units:
            shared, limit = 0, min(len(unit), len(before))
            while shared < limit and unit[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                for size in lengths.get(unit[end - 2 : end], ()) if end > 1 else ():
                    start = end - size
                    piece = unit[start:end]
                    if start >= 0 and piece in whole:
                        left = last[start]
                        fits = known.get((left, piece)) if start else True
                        if fits or fits is None and self.follows(left, piece):
                            last.append(piece)
                            break
                else:
                    last.append(unit[end - 1])
            path, at = [], len(unit)
            while at:
                path.append(last[at])
                at -= len(last[at])
            ids: list[int] = []
            for piece in reversed(path):
                k = single(piece)
                if k is None:
                    ids += self.lookup(piece)
                else:
                    ids.append(k)
            self.units[unit] = tuple(ids)
            before = unit

    def lookup(self, piece: str) -> list[int]:
        """The id of a piece, or those of its bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def cut(self, word: str) -> list[str]:
        """A marked word in units that nothing merges across."""
        out, at = [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.neighbours:
                out.append(word[at:k])
                at = k
        return [*out, word[at:]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry at the end)."""
        words, bounds = marked_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > WORD_CACHE:
            self.forget()
            new = distinct
        if len(self.units) > WORD_CACHE or len(self.compatible) > 5 * WORD_CACHE:
            self.units.clear()
            self.compatible.clear()
        self.learn(new)
        known, starts = self.store
        place = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        first = starts[place]
        size = starts[place + 1] - first
        total = np.concatenate([[0], np.cumsum(size)])
        ids = known[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[bounds]

    def decode(self, rows: pa.Array) -> pa.Array:
        """Texts of id lists: bytes are joined to characters, marks become spaces, the first one goes."""
        sizes = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
        parts = self.table.take(rows.flatten())
        data = text_bytes(parts)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        try:
            texts = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids whose bytes are no characters
            texts = pa.array([r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.large_string())
        return pc.replace_substring_regex(pc.replace_substring(texts, MARK, " "), r"\A ", "", max_replacements=1)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of every text; null and empty texts have no ids.

    The mark itself counts as a space, as in the library. Repeated rows and null
    identifiers are rows like any other; an empty table gives an empty result; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch, texts in text_chunks(batches):
            flat, ends = model.encode(texts)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=["id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """id, ids, text of rows (id, ids); null ids give an empty text, ids of control pieces none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ID_ROWS):
                batch = whole.slice(at, ID_ROWS)
                yield pa.record_batch([batch.column("id"), batch.column("ids"), model.decode(batch.column("ids")).cast(pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, text string")


def default_pieces() -> str:
    """Where the piece model lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
