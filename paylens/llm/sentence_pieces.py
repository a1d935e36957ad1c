"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search goes over the characters of the escaped text. For every boundary it
keeps one backpointer: the piece that ends there in the encoding of the text up
to it. Which piece survives follows from the vocabulary's merge ranks: a piece may
follow another only if merging the two together by rank gives exactly these two,
and for each boundary one piece fulfils that. (Summed scores, as for unigram
vocabularies, would not give a merge vocabulary's own ids.) Only the boundaries
within the longest piece of the present place can still be pointed to, so only
they are kept; as soon as the paths back from all of them meet in one boundary,
everything before it is final and leaves the window.

Paths always meet where no piece can span: before a word-start mark that follows
other text, around a line break, and between letters and other characters (all
checked on the vocabulary). The stretches between such places are searched once
and remembered, up to a bounded number of them. What ends at a boundary depends on
the text before it alone, so stretches that begin alike share what was found for
their common beginning; that is remembered too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "▁"
_LETTERS, _OTHERS = r"[^\W\d_²³¹]", rf"(?:[^\w{_MARK}\n]|[\d_²³¹])"
_STRETCH = re.compile(rf"{_MARK}*{_LETTERS}+|{_MARK}*{_OTHERS}+|{_MARK}+|\n")
_MIXED = re.compile(rf"{_LETTERS}{_OTHERS}|{_OTHERS}{_LETTERS}|[^{_MARK}]{_MARK}|.\n|\n.")
_REMEMBERED = 300_000
_TAIL = 4  # characters at the end of a piece by which its possible lengths are looked up
_BEGINNING = 24  # characters of a beginning that is remembered


class Vocabulary:
    """Pieces and merge ranks of a SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.ranks: dict[str, float] = {}
        self.bytes: dict[int, int] = {}  # byte value to id
        self.byte_of: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(piece)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.ranks[piece] = -model.get_score(i)
        self.longest = max(map(len, self.ids))
        # Lengths, longest first, of the pieces that end with a tail; shorter ones always count.
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) >= _TAIL:
                lengths.setdefault(piece[-_TAIL:], set(range(1, _TAIL))).add(len(piece))
        self.by_tail = {t: sorted(found, reverse=True) for t, found in lengths.items()}
        if any(map(_MIXED.search, self.ids)):
            raise ValueError("pieces that span words, or letters and others, are not supported")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best rank first, leftmost among equals."""
        parts, ranks = list(text), self.ranks
        costs = [ranks.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == np.inf:
                break
            k = costs.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            costs[k:k + 1] = []
            if k:
                costs[k - 1] = ranks.get(parts[k - 1] + parts[k], np.inf)
            if k < len(costs):
                costs[k] = ranks.get(parts[k] + parts[k + 1], np.inf)
        return parts


class Search:
    """Streaming search over one stretch at a time, with memory of stretches and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._lengths = [len(p) for p in vocabulary.pieces]
        self._id_bytes = [i.to_bytes(4, "little") for i in range(len(vocabulary.pieces))]
        self._pairs: dict[int, bool] = {}
        self._whole: dict[str, int] = {}  # piece to id; -1 if it is not its own encoding
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # what was known before the last time it was full
        self._ends: dict[str, int] = {}  # beginning of a stretch to the piece that ends there

    def _standing(self, piece: str) -> int:
        """The id of a piece that is its own encoding, else -1."""
        number = self.vocabulary.ids.get(piece, -1)
        if number >= 0 and len(piece) > 1 and self.vocabulary.merged(piece) != [piece]:
            number = -1
        if number >= 0 or piece in self.vocabulary.ids:
            self._whole[piece] = number
        return number

    def _follows(self, key: int, before: int, after: int) -> bool:
        pieces = self.vocabulary.pieces
        left, right = pieces[before], pieces[after]
        found = self.vocabulary.merged(left + right) == [left, right]
        if len(self._pairs) > 2 * _REMEMBERED:
            self._pairs.clear()
        self._pairs[key] = found
        return found

    def stream(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in parts, each as soon as it is final.

        ``window`` holds the characters since the last final boundary, ``last[k]`` the
        piece that ends at boundary k: its id, or -1 for a character without one.
        """
        ids, longest, lengths = self.vocabulary.ids, self.vocabulary.longest, self._lengths
        whole, pairs, ends_ = self._whole, self._pairs, self._ends
        by_tail, short = self.vocabulary.by_tail, range(_TAIL - 1, 0, -1)
        window, last, done, limit = "", [-1], 0, 2 * longest
        if len(ends_) > 2 * _REMEMBERED:
            ends_.clear()
        beginning = True  # nothing has left the window yet
        for part in parts:
            for first in range(0, len(part), limit):
                window += part[first:first + limit]
                for end in range(done + 1, len(window) + 1):
                    if beginning and end <= _BEGINNING:
                        chosen = ends_.get(window[:end])
                        if chosen is not None:
                            last.append(chosen)
                            continue
                    chosen = -1
                    tail = window[end - _TAIL:end] if end >= _TAIL else ""
                    for length in by_tail.get(tail, short):
                        start = end - length
                        if start < 0:
                            continue
                        piece = window[start:end]
                        number = whole.get(piece)
                        if number is None:
                            if piece not in ids:
                                continue
                            number = self._standing(piece)
                        if number < 0:
                            continue
                        before = last[start]
                        if before < 0:
                            chosen = number
                            break
                        key = before << 20 | number
                        follows = pairs.get(key)
                        if follows is None:
                            follows = self._follows(key, before, number)
                        if follows:
                            chosen = number
                            break
                    last.append(chosen)
                    if beginning and end <= _BEGINNING:
                        ends_[window[:end]] = chosen
                done = len(window)
                if done >= limit:
                    # Boundaries that a later piece can start from, and where their paths meet.
                    ends = set(range(done + 1 - longest, done + 1))
                    while len(ends) > 1:
                        latest = max(ends)
                        ends.discard(latest)
                        ends.add(latest - (lengths[last[latest]] if last[latest] >= 0 else 1))
                    meet = ends.pop()
                    if meet:
                        yield self._path(window, last, meet)
                        # What comes next depends on the piece before the cut, which stays.
                        window, last, done = window[meet:], last[meet:], done - meet
                        beginning = False
        yield self._path(window, last, done)

    def _path(self, window: str, last: list[int], end: int) -> bytes:
        found = []
        while end:
            number = last[end]
            if number >= 0:
                found.append(self._id_bytes[number])
                end -= self._lengths[number]
            else:
                end -= 1
                found.extend(self._id_bytes[self.vocabulary.bytes[b]]
                             for b in reversed(window[end].encode("utf-8", "replace")))
        return b"".join(reversed(found))

    def _ids_of(self, stretch: str) -> bytes:
        return b"".join(self.stream((stretch,)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        stretches = _STRETCH.findall(_MARK + text.replace(" ", _MARK))
        try:
            return b"".join(map(self._known.__getitem__, stretches))
        except KeyError:
            pass
        if len(self._known) > _REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        for stretch in stretches:
            if stretch not in known:
                known[stretch] = older.get(stretch) or self._ids_of(stretch)
        return b"".join(map(known.__getitem__, stretches))

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids: marks become spaces, the leading one goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        pieces, byte_of = self.vocabulary.pieces, self.vocabulary.byte_of
        if byte_of.keys().isdisjoint(numbers):
            text = "".join(map(pieces.__getitem__, numbers))
        else:
            raw = [bytes([byte_of[i]]) if i in byte_of else pieces[i].encode() for i in numbers]
            text = b"".join(raw).decode("utf-8", "replace")
        text = text.replace(_MARK, " ")
        return text[1:] if text.startswith(" ") else text


def piece_model() -> str:
    """The installed public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_SEARCHES: dict[str, Search] = {}  # one per worker and vocabulary file


def _search(path: str) -> Search:
    if path not in _SEARCHES:
        _SEARCHES[path] = Search(Vocabulary(path))
    return _SEARCHES[path]


def _pieces(bytes_of: list[bytes]) -> Iterator[slice]:
    """Runs of rows with about four million ids, as list offsets are 32-bit numbers."""
    first, held = 0, 0
    for k, value in enumerate(bytes_of):
        held += len(value)
        if held > 16 << 20:
            yield slice(first, k + 1)
            first, held = k + 1, 0
    yield slice(first, len(bytes_of))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """All columns of ``docs``, nested in ``row_``, and ``ids``: array<int>.

    ``vocabulary`` is the model file, at the same place on every machine. Null and
    empty texts have no ids. Rows are independent: repeated rows, other columns of
    any name and empty tables pass through.
    """
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
                       F.col("text").cast("string").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(vocabulary)
        for batch in batches:
            made = [search.encode(t) for t in batch.column("body").to_pylist()]
            for part in _pieces(made):
                held = made[part]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held], dtype=int)))
                flat = np.frombuffer(b"".join(held), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_").slice(part.start, len(held)), ids],
                    names=["row_", "ids"])

    made = T.StructType([wide.schema["row_"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return wide.mapInArrow(run, made)


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (row_, ids) with ``decoded``: the text of the ids; null ids give null."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(vocabulary)
        for batch in batches:
            texts = [None if x is None else search.decode(np.array(x, "<u4").tobytes())
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_"), batch.column("ids"), pa.array(texts, pa.string())],
                names=["row_", "ids", "decoded"])

    made = T.StructType([ids.schema["row_"], ids.schema["ids"],
                         T.StructField("decoded", T.StringType())])
    return ids.mapInArrow(run, made)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, same): encoded and decoded again in one pass.

    ids_crc32: of the ids as little-endian 32-bit integers. same: the decoded text is
    the text, word-start marks read as spaces; a null text counts as empty.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(vocabulary)
        for batch in batches:
            counts, sums, same = [], [], []
            for value in batch.column("body"):
                text = value.as_py() or ""
                ids = search.encode(text)
                counts.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                same.append(search.decode(ids) == text.replace(_MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "same"])

    return narrow.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, same boolean")
