"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A text is cut as the public pattern would cut it, but by no pattern matcher: every
code point gets a class, every class a function on the states of a small automaton,
and these functions are composed by a scan, which is associative, so blocks of a text
are worked on side by side and a window hands its state to the next. The different
pieces of some megabytes of text are merged together, pair by pair in the order of the
ranks, and remembered by the worker. Ids come with the byte offsets at which they end,
so any stretch of ids can be decoded, or found in the text, without the rest.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices

_REMEMBERED = 300_000  # pieces a worker keeps
_LONG = 64  # bytes; longer pieces are merged one by one with a heap
_WINDOW = 1 << 20  # symbols scanned at once
_BLOCK = 256  # symbols of a block of the scan
_IDS_AT_ONCE = 1 << 20  # ids decoded at once
_NONE = np.iinfo(np.int32).max

# Classes of code points. MARK is the apostrophe; STMD and the single letters are those
# that can follow it in 's 't 'm 'd 're 've 'll. END stands between texts, PAD for nothing.
(_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE, _MARK, _STMD, _R, _V, _E, _L, _END,
 _PAD) = range(13)
_CLASSES = 13
# What has been read: nothing, a run of one kind, white space that ends with a blank or
# with another space, an apostrophe that opens a piece, that with r, v or l, or a whole 's.
(_START, _LETTERS, _NUMBERS, _OTHERS, _BLANKS, _SPACES, _QUOTE, _QUOTE_R, _QUOTE_V,
 _QUOTE_L, _CUT) = range(11)
_STATES = 11
_HERE, _BEFORE = 1, 2  # a piece begins at this symbol, at the one before

_ENTERED = {_LETTER: _LETTERS, _STMD: _LETTERS, _R: _LETTERS, _V: _LETTERS, _E: _LETTERS,
            _L: _LETTERS, _NUMBER: _NUMBERS, _OTHER: _OTHERS, _BLANK: _BLANKS,
            _SPACE: _SPACES, _MARK: _QUOTE}


def _step(state: int, symbol: int) -> tuple[int, int]:
    """The next state, and which pieces begin."""
    if symbol == _PAD:
        return state, 0
    if symbol == _END:
        return _START, _BEFORE if state in (_QUOTE_R, _QUOTE_V, _QUOTE_L) else 0
    entered = _ENTERED[symbol]
    if state in (_START, _CUT):
        return entered, _HERE
    late = 0
    if state == _QUOTE:
        after = {_STMD: _CUT, _R: _QUOTE_R, _V: _QUOTE_V, _L: _QUOTE_L}
        if symbol in after:
            return after[symbol], 0
        state = _OTHERS
    elif state in (_QUOTE_R, _QUOTE_V, _QUOTE_L):
        if symbol == (_L if state == _QUOTE_L else _E):
            return _CUT, 0
        state, late = _LETTERS, _BEFORE  # the letter after the apostrophe began a word
    if symbol in (_BLANK, _SPACE):
        return entered, late if state in (_BLANKS, _SPACES) else late | _HERE
    run = _OTHERS if symbol == _MARK else entered
    if state == _BLANKS:
        return run, _BEFORE  # one blank belongs to what follows
    if state == _SPACES:
        return entered, _BEFORE | _HERE
    return (run, late) if state == run else (entered, late | _HERE)


class _Automaton:
    """The automaton's tables, and all functions that sequences of symbols can have."""

    def __init__(self):
        steps = [[_step(state, symbol) for symbol in range(_CLASSES)] for state in range(_STATES)]
        self.following = np.array([[s for s, _ in row] for row in steps], np.uint8).ravel()
        self.marks = np.array([[m for _, m in row] for row in steps], np.uint8).ravel()
        single = [tuple(row[symbol][0] for row in steps) for symbol in range(_CLASSES)]
        found = {single[_PAD]: 0}  # the identity
        queue = list(found)
        for f in queue:
            for g in single:
                h = tuple(g[s] for s in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        functions = np.array(queue)
        number = {f: k for k, f in enumerate(queue)}
        self.functions = functions.astype(np.uint8)
        self.count = len(queue)
        self.then_symbol = np.array(
            [[number[tuple(np.array(g)[f])] for g in single] for f in functions], np.intp).ravel()
        self.then = np.array(
            [[number[tuple(g[f])] for g in functions] for f in functions], np.intp).ravel()

    def scan(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What begins at each symbol, and the state after the last, from ``state`` on."""
        n = len(symbols)
        blocks = -(-n // _BLOCK)
        padded = np.full(blocks * _BLOCK, _PAD, np.uint8)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
        whole = np.zeros(blocks, np.intp)
        for column in columns:  # the function of every block
            whole = self.then_symbol.take(whole * _CLASSES + column)
        step = 1
        while step < blocks:  # of every prefix of blocks
            whole[step:] = self.then.take(whole[:-step] * self.count + whole[step:])
            step *= 2
        after = self.functions[whole, state]
        states = np.concatenate(([state], after[:-1])).astype(np.intp)
        found = np.empty_like(columns)
        for k, column in enumerate(columns):  # inside the blocks, from a known state
            at = states * _CLASSES + column
            found[k] = self.marks.take(at)
            states = self.following.take(at).astype(np.intp)
        return found.T.ravel()[:n], int(after[-1])


@cache
def _automaton() -> _Automaton:
    return _Automaton()


@cache
def code_point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library to agree with.

    The library cuts with its own version of Unicode, so it is asked once which code
    points are letters, numbers and white space.
    """
    import tiktoken

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        having = tiktoken.Encoding("one", pat_str=name, mergeable_ranks=single, special_tokens={})
        text = bytes(having.encode_ordinary(every)).decode()
        table[np.frombuffer(text.encode("utf-32-le"), "<u4")] = kind
    table[ord(" ")], table[ord("'")] = _BLANK, _MARK
    for letters, kind in (("stmd", _STMD), ("r", _R), ("v", _V), ("e", _E), ("l", _L)):
        table[[ord(c) for c in letters]] = kind
    return table


@cache
def is_space() -> np.ndarray:
    """Whether a code point is white space to the library."""
    table = code_point_classes()
    return (table == _BLANK) | (table == _SPACE)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where pieces begin; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    opens = np.zeros(len(leads) + 1, bool)
    ends = np.searchsorted(leads, offsets[1:])  # in code points
    machine, table, state, first, text = _automaton(), code_point_classes(), _START, 0, 0
    while first < len(leads):
        past = min(first + _WINDOW, len(leads))
        raw = data[leads[first]:leads[past] if past < len(leads) else len(data)]
        symbols = table[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
        last = int(np.searchsorted(ends, past, "left" if past < len(leads) else "right"))
        at = ends[text:last] - first  # texts that end before a symbol of this window
        marks, state = machine.scan(np.insert(symbols, at, _END), state)
        is_end = np.zeros(len(marks), bool)
        is_end[at + np.arange(len(at))] = True
        opens[first:past] |= (marks[~is_end] & _HERE) > 0
        # An END or a symbol may say that the code point before it began a piece.
        place = first - 1 + np.cumsum(~is_end)
        place[~is_end] -= 1
        late = place[(marks & _BEFORE) > 0]
        opens[late] = True
        first, text = past, last
    return leads[opens[:-1]]


class Vocabulary:
    """Token bytes by id, and the id that any two neighbouring tokens merge into."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank)
                          for token, rank in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.size, self.tokens = size, pa.array(tokens, pa.large_binary())
        self.lengths = np.array([len(t or b"") for t in tokens], np.int32)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._merged = np.append(
            np.fromiter(pairs.values(), np.int32, len(pairs))[order], np.int32(_NONE))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the tokens ``a`` + ``b``; a number above all ids where there is none."""
        key = a * self.size + b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._merged[at], _NONE)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of one long piece: the lowest rank first, of equal ones the leftmost."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[k:k + 2]], k, k + 2) for k in range(n - 1) if piece[k:k + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, k, past = heapq.heappop(heap)
        middle = end[k]
        if not middle or middle >= n or end[middle] != past:
            continue  # one of the two parts has changed since
        end[k], end[middle] = past, 0
        if past < n:
            before[past] = k
            rank = ranks.get(piece[k:end[past]])
            if rank is not None:
                heapq.heappush(heap, (rank, k, end[past]))
        if before[k] >= 0:
            rank = ranks.get(piece[before[k]:past])
            if rank is not None:
                heapq.heappush(heap, (rank, before[k], past))
    found, k = [], 0
    while k < n:
        found.append(ranks[piece[k:end[k]]])
        k = end[k]
    return found


def _merge_short(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count per piece): one merge in every piece per round, all pieces together."""
    sizes = np.array([len(p) for p in pieces])
    tokens = vocabulary.single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    ranks = np.full(len(tokens), _NONE, np.int64)  # of the pair that begins here
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    ranks[inside] = vocabulary.merged(tokens[inside], tokens[inside + 1])
    done_tokens, done_owners = [], []
    while len(tokens):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lowest = np.minimum.reduceat(ranks, starts)
        counts = np.diff(np.append(starts, len(tokens)))
        open_ = np.repeat(lowest < _NONE, counts)
        done_tokens.append(tokens[~open_])
        done_owners.append(owner[~open_])
        hits = np.flatnonzero(open_ & (ranks == np.repeat(lowest, counts)))
        if not len(hits):
            break
        hits = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]
        tokens[hits] = ranks[hits]
        ranks[hits] = ranks[hits + 1]  # not the pair's rank yet, but _NONE at the end of a piece
        kept = open_.copy()
        kept[hits + 1] = False
        changed = np.zeros(len(tokens), bool)
        changed[hits] = True
        tokens, owner, ranks, changed = tokens[kept], owner[kept], ranks[kept], changed[kept]
        at = np.flatnonzero(changed)
        for left in (at, at[at > 0] - 1):
            left = left[left + 1 < len(tokens)]
            left = left[owner[left] == owner[left + 1]]
            ranks[left] = vocabulary.merged(tokens[left], tokens[left + 1])
        last = at[np.append(owner, -1)[at + 1] != owner[at]]
        ranks[last] = _NONE
    tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owners)
    order = np.argsort(owner, kind="stable")
    return tokens[order], np.bincount(owner, minlength=len(pieces))


class Codec:
    """Encodes and decodes; keeps the ids of pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self._row: dict[bytes, int] = {}
        self._ids, self._first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        ranks = self.vocabulary.ranks
        tokens = [p for p in pieces if p in ranks]  # a piece that is a token is never merged
        rest = [p for p in pieces if p not in ranks]
        long = [p for p in rest if len(p) > _LONG]
        short = [p for p in rest if len(p) <= _LONG]
        merged = [_merge_long(p, ranks) for p in long]
        flat = [np.array([ranks[p] for p in tokens], np.int32),
                np.array([i for ids in merged for i in ids], np.int32)]
        counts = [np.ones(len(tokens), np.int64), np.array([len(m) for m in merged], np.int64)]
        if short:
            ids, sizes = _merge_short(short, self.vocabulary)
            flat.append(ids.astype(np.int32))
            counts.append(sizes)
        self._row.update(zip([*tokens, *long, *short],
                             range(len(self._row), len(self._row) + len(pieces))))
        past = self._first[-1] + np.cumsum(np.concatenate(counts))
        self._first = np.concatenate((self._first, past))
        self._ids = np.concatenate((self._ids, *flat))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, counts): the ids of all texts, the byte at which each ends, ids per text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, buffer, raw = texts.buffers()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if buffer is not None and len(texts):
            offsets = np.frombuffer(buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets)
        # Pieces lie side by side, so the text itself is the data of an array of pieces.
        bounds = np.append(starts, len(data)).astype(np.int64)
        tiles = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = tiles.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self._row) > _REMEMBERED:
            self._forget()
        new = [p for p in pieces if p not in self._row]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self._row.__getitem__, pieces), np.int64, len(pieces))
        rows = rows[coded.indices.to_numpy()]
        counts = self._first[rows + 1] - self._first[rows]
        past = np.cumsum(counts)
        ids = self._ids[np.repeat(self._first[rows] - past + counts, counts) + np.arange(past[-1])]
        per_text = np.diff(np.append(0, past)[np.searchsorted(starts, offsets)])
        ends = np.cumsum(self.vocabulary.lengths[ids], dtype=np.int64)
        return ids, ends - np.repeat(offsets[:-1], per_text), per_text

    def decode(self, ids: np.ndarray) -> pa.Array:
        """The bytes of every id; their data buffer is the bytes of all of them."""
        return self.vocabulary.tokens.take(pa.array(ids))


_CODECS: dict[str, Codec] = {}  # one per worker and vocabulary file


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(Vocabulary(path))
    return _CODECS[path]


def many_languages() -> str:
    """The installed public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _bytes_of(tool: Codec, lists: pa.Array, ends: pa.Array) -> pa.Array:
    """The bytes of every list of ids, which must end where ``ends`` says."""
    counts = lists.value_lengths().fill_null(0).to_numpy()
    flat = tool.decode(lists.flatten().to_numpy(zero_copy_only=False))
    _, buffer, data = flat.buffers()
    places = np.zeros(1, np.int64)
    if len(flat):
        places = np.frombuffer(buffer, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    _same_ends(ends, np.diff(places), counts)
    spans = places[np.concatenate(([0], np.cumsum(counts)))]
    first, last = int(spans[0]), int(spans[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    valid = pa.array(np.array(lists.is_valid()))  # a bitmap of its own, without an offset
    return pa.Array.from_buffers(
        pa.binary(), len(lists),
        [valid.buffers()[1], pa.py_buffer((spans - first).astype(np.int32)), pa.py_buffer(raw)])


def _same_ends(ends: pa.Array, lengths: np.ndarray, counts: np.ndarray) -> None:
    told = ends.value_lengths().to_numpy(zero_copy_only=False)
    if ends.null_count:
        lengths = lengths[np.repeat(np.array(ends.is_valid()), counts)]
        counts = counts[np.array(ends.is_valid())]
        told = told[np.array(ends.is_valid())]
    past = np.cumsum(lengths)
    base = np.repeat(np.append(0, past)[np.concatenate(([0], np.cumsum(counts)))[:-1]], counts)
    if not np.array_equal(told, counts) or not np.array_equal(
            past - base, ends.flatten().to_numpy(zero_copy_only=False)):
        raise ValueError("ids and ends do not belong together")


def _prepared(docs: DataFrame, keep: Sequence[str] | None) -> DataFrame:
    kept = docs.columns if keep is None else keep
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row_"),
                       F.expr("make_valid_utf8(CAST(text AS STRING))").alias("body"))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_ENDS = T.StructField("ends", T.ArrayType(T.IntegerType()))
_BYTES = T.StructField("decoded", T.BinaryType())


def encoded(docs: DataFrame, vocabulary: str, keep: Sequence[str] | None = None,
            decode: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all), nested in ``row_``, with ``ids`` and ``ends``.

    ids: array<int>. ends: array<int>, the byte of the UTF-8 text at which each id ends.
    With ``decode`` also ``decoded``, the bytes that the ids stand for.
    ``vocabulary`` is a file of base64 tokens and ranks, at the same place on every
    machine. Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD.
    Rows are independent: repeated rows and ids, null ids, other columns of any name and
    empty tables pass through. A long text is scanned in windows and never cut.
    """
    wide = _prepared(docs, keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, "body"):
                ids, ends, counts = tool.encode(part.column("body"))
                made = [_lists(ids, counts), _lists(ends, counts)]
                if decode:
                    made.append(_bytes_of(tool, *made))
                yield pa.RecordBatch.from_arrays([part.column("row_"), *made], names=names)

    made = T.StructType([wide.schema["row_"], _IDS, _ENDS, *([_BYTES] if decode else [])])
    names = made.names
    return wide.mapInArrow(run, made)


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (row_, ids, ends) as (row_, ids, decoded): the bytes of the ids; null ids give null.

    Ids whose bytes do not end where ``ends`` says are an error: they belong to another
    vocabulary. Null ``ends`` are not compared.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            sizes = batch.column("ids").value_lengths().fill_null(0).to_numpy()
            first = 0
            while first < batch.num_rows:
                count = int(np.searchsorted(np.cumsum(sizes[first:]), _IDS_AT_ONCE)) + 1
                part = batch.slice(first, count)
                lists = part.column("ids")
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_"), lists, _bytes_of(tool, lists, part.column("ends"))],
                    names=["row_", "ids", "decoded"])
                first += count

    made = T.StructType([ids.schema["row_"], _IDS, _BYTES])
    return ids.select("row_", "ids", "ends").mapInArrow(run, made)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded from the ids.

    ids_sha256: of the decimal ids joined by commas. Both hashes are lowercase hex.
    """
    made = encoded(docs.select("doc_id", "text"), vocabulary, ["doc_id"], decode=True)
    return made.selectExpr(
        "row_.doc_id AS doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens",
        "sha2(CAST(array_join(CAST(ids AS ARRAY<STRING>), ',') AS BINARY), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256")
