"""Periodic runs of words, and texts with each run collapsed to one period.

A run is a stretch of words with smallest period q, at least two periods and ``least``
words long, that no neighbouring word extends. A run of period p holds two words p apart
that are equal at one point of every grid of step max(p, least - p), so each period needs
about n / p points, a harmonic sum over all periods. From a point the run is measured by
longest common extensions, forward and backward.

Extensions are answered by a difference cover: of every 13 places those whose remainder
is in {0, 1, 3, 9}. Any two places reach such places together within 12 words, which are
compared one by one; only suffixes that begin at such places are sorted, and the smallest
common prefix between two of them is one look-up in a sparse table. Documents in which no
point passes a comparison of a few words need no suffixes at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices
from .expressions import let

_COVER, _MODULUS = (0, 1, 3, 9), 13  # every difference mod 13 is one between two of these
_FEW = 8  # words compared at a grid point before suffixes are sorted
_POINTS = 1 << 20  # grid points held at once
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Extensions:
    """Longest common extensions between places of ``codes``.

    The first and the last code stand nowhere else; so no extension passes the end.
    """

    def __init__(self, codes: np.ndarray):
        v, n = _MODULUS, len(codes)
        self.codes = np.concatenate((codes, np.full(v, codes[-1], codes.dtype)))
        residues = np.arange(v)
        covered = np.isin((residues[:, None] + residues) % v, _COVER)  # [residue, shift]
        self.shift = np.argmax(covered[:, None, :] & covered[None, :, :], axis=2)
        classes = [np.arange(r, n, v) for r in _COVER]
        self.first = np.zeros(v, np.int64)
        self.first[list(_COVER)] = np.cumsum([0, *map(len, classes[:-1])])
        self._sort(np.concatenate(classes), np.cumsum(list(map(len, classes))))

    def _sort(self, places: np.ndarray, class_ends: np.ndarray) -> None:
        """Ranks of the covered suffixes by prefixes of 13, 26, 52 ... words, and their table."""
        m, columns = len(places), [self.codes[places + t] for t in range(_MODULUS)]
        order = np.lexsort(columns[::-1])
        differs = np.zeros(m, bool)
        for column in columns:
            held = column[order]
            differs[1:] |= held[1:] != held[:-1]
        rank = np.empty(m, np.int32)
        rank[order] = np.maximum.accumulate(np.where(differs, np.arange(m), 0))
        ends = np.repeat(class_ends, np.diff(np.append(0, class_ends)))  # of a sample's class
        levels, step = [rank], 1
        while True:
            tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
            if not len(tied):
                break
            ahead = tied + step
            then = np.where(ahead < ends[tied], rank[np.minimum(ahead, m - 1)], -1)
            order = np.lexsort((then, rank[tied]))
            group, then = rank[tied][order], then[order]
            new_group = np.concatenate(([True], group[1:] != group[:-1]))
            new = new_group | np.concatenate(([True], then[1:] != then[:-1]))
            at = np.arange(len(tied))
            inside = at - np.maximum.accumulate(np.where(new_group, at, 0))
            finer = np.maximum.accumulate(np.where(new, group + inside, 0))
            rank = rank.copy()
            rank[tied[order]] = finer
            levels.append(rank)
            step *= 2
        self.rank = rank
        self.table = [self._neighbours(places, levels)]
        width = 1
        while 2 * width <= m:
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def _neighbours(self, places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sorted suffix and the one before it."""
        order = np.argsort(levels[-1])
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][x] == levels[k][y]
            common[same] += _MODULUS << k
            x[same] += 1 << k
            y[same] += 1 << k
        common += self._compared(places[x], places[y], np.full(len(x), _MODULUS))
        return np.concatenate(([0], common)).astype(np.int32)

    def _compared(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, at most ``limit``, word by word."""
        found, at, t = np.zeros(len(i), np.int64), np.flatnonzero(limit > 0), 0
        while len(at):
            at = at[self.codes[i[at] + t] == self.codes[j[at] + t]]
            t += 1
            found[at] = t
            at = at[limit[at] > t]
        return found

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on; ``i`` differs from ``j``."""
        shift = self.shift[i % _MODULUS, j % _MODULUS]
        found = self._compared(i, j, shift)
        on = np.flatnonzero(found == shift)
        x, y = i[on] + shift[on], j[on] + shift[on]
        a = self.rank[self.first[x % _MODULUS] + x // _MODULUS]
        b = self.rank[self.first[y % _MODULUS] + y // _MODULUS]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        power = np.frexp(high - low)[1] - 1
        for k in np.unique(power):
            at = power == k
            part = self.table[k]
            found[on[at]] += np.minimum(part[low[at]], part[high[at] - (1 << int(k))])
        return found


def _grid(starts: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple]:
    """(places, periods) of the grid points of texts that begin at ``starts``."""
    periods = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(p, least - p)
    counts = (sizes[text] - p - 1) // step + 1
    past = np.cumsum(counts)
    first = 0
    while first < len(text):
        before = past[first - 1] if first else 0
        last = max(int(np.searchsorted(past, before + _POINTS, "right")), first + 1)
        some, k = slice(first, last), counts[first:last]
        number = np.arange(int(past[last - 1] - before)) - np.repeat(past[some] - before - k, k)
        yield (np.repeat(starts[text[some]], k) + number * np.repeat(step[some], k),
               np.repeat(p[some], k))
        first = last


def _promising(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> Iterator:
    """Grid points whose neighbourhood may belong to a run, by a few words on either side."""
    reach = len(codes) - 1
    for i, p in _grid(starts, sizes, least):
        at = np.flatnonzero(codes[i] == codes[i + p])
        i, p = i[at], p[at]
        total = np.ones(len(i), np.int64)
        for side in (1, -1):
            going = np.arange(len(i))
            for t in range(1, _FEW):
                left, right = i[going] + side * t, i[going] + p[going] + side * t
                same = codes[np.maximum(left, 0)] == codes[np.minimum(right, reach)]
                going = going[same & (left >= 0) & (right <= reach)]
                total[going] += 1
        # _FEW - 1 words on one side may go on; below that the count is exact.
        on = total >= np.minimum(np.maximum(least - p, p), _FEW)
        yield i[on], p[on]


def _separated(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with a number of its own before, between and after the texts; where texts begin."""
    starts = np.cumsum(counts + 1) - counts
    out = -1 - np.arange(len(codes) + len(counts) + 1, dtype=np.int64)
    inside = np.arange(len(codes)) + np.repeat(np.arange(1, len(counts) + 1), counts)
    out[inside] = codes
    return out.astype(np.int32), starts


def _first_of_each(start, end, period):
    """One line per stretch, with its smallest period, by start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs(codes: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run in texts of word codes, by text, start, period.

    Text ``i`` has ``counts[i]`` of the codes, which are 0 or more.
    """
    whole, starts = _separated(codes, counts)
    marked = np.zeros(len(counts), bool)
    for i, _ in _promising(whole, starts, counts, least):
        marked[np.searchsorted(starts, i, "right") - 1] = True
    texts = np.flatnonzero(marked)
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none, none
    codes, starts = _separated(codes[np.repeat(marked, counts)], counts[texts])
    ahead, back = Extensions(codes), Extensions(codes[::-1])
    found = (none, none, none)
    for i, p in _promising(codes, starts, counts[texts], least):
        # In the reversed codes, what stands before place i begins at len - i.
        begin = i - back.forward(len(codes) - i, len(codes) - i - p)
        end = i + p + ahead.forward(i, i + p)
        long = end - begin >= np.maximum(least, 2 * p)
        found = _first_of_each(
            *(np.concatenate((a, b[long])) for a, b in zip(found, (begin, end, p))))
    begin, end, p = found
    text = np.searchsorted(starts, begin, "right") - 1
    order = np.lexsort((p, begin))
    return tuple(x[order] for x in (texts[text], begin - starts[text], end - begin, p))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and how many each text has; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, buffer, raw = texts.buffers()
    n = len(texts)
    offsets = np.zeros(n + 1, np.int64)
    if buffer is not None and n:
        offsets = np.frombuffer(buffer, np.int64)[texts.offset:texts.offset + n + 1]
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.large_binary()), np.zeros(n, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= solid[1:] != solid[:-1]
    bounds = np.flatnonzero(cut)  # words and gaps lie side by side
    tiles = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                  [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    at = np.flatnonzero(solid[bounds[:-1]])
    return tiles.take(pa.array(at)), np.diff(np.searchsorted(bounds[at], offsets))


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _described(texts: pa.Array, least: int) -> list[pa.Array]:
    """(n_words, runs, collapsed) of every text."""
    words, counts = _words(texts)
    codes = words.dictionary_encode().indices.to_numpy()
    text, start, length, period = runs(codes, counts, least)
    base = np.cumsum(counts) - counts
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, base[text] + start + period, 1)
    np.add.at(change, base[text] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(kept)))[np.append(0, np.cumsum(counts))]
    lists = pa.ListArray.from_arrays(  # no text has 2^31 words
        pa.array(left.astype(np.int32)),
        words.take(pa.array(np.flatnonzero(kept))).cast(pa.large_string()))
    lines = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (start, length, period)], names=_RUN.names)
    held = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
    return [pa.array(counts), pa.ListArray.from_arrays(pa.array(held), lines),
            pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())]


def word_runs(docs: DataFrame, least: int = 12, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all), nested in ``row_``, with their runs.

    Added: n_words; runs, an array of (start, length, period) counted in words from 0, by
    start and period; collapsed, the words that stand in no run after its first period,
    joined by single spaces. Words are separated by white space (U+0009-000D, U+0020), and
    equal only if all their characters are. Null and empty texts have no words, no runs and
    an empty ``collapsed``. Rows are independent: repeated rows and ids, null ids, other
    columns of any name and empty tables pass through. Whole texts are searched, whatever
    their length; one text is the work of one task.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kept = docs.columns if keep is None else keep
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row_"),
                       F.expr("make_valid_utf8(CAST(text AS STRING))").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_"), *_described(part.column("body"), least)],
                    names=["row_", "n_words", "runs", "collapsed"])

    made = T.StructType([
        wide.schema["row_"], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return wide.mapInArrow(run, made)


_SPLIT = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_HASH = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY))"


def with_repetitions() -> str:
    """SQL for the text of a document, made periodic for one in ten by a hash of doc_id.

    In those every word from place a on becomes word a + (i - a) % p, where h is the hash,
    g = h / 10, a = g % n and p = 1 + (n - a) / (3 + g % 8), in whole numbers.
    """
    word = "words[CAST(if(i < a, i, a + (i - a) % p) AS INT)]"
    made = f"array_join(transform(sequence(0, size(words) - 1), i -> {word}), ' ')"
    made = let("p", "1 + (size(words) - a) DIV (3 + g % 8)", made)
    made = let("a", "g % size(words)", made)
    made = let("words", _SPLIT, f"CASE WHEN size(words) = 0 THEN '' ELSE {made} END")
    made = let("g", f"{_HASH} DIV 10", made)
    return f"CASE WHEN text IS NOT NULL AND {_HASH} % 10 = 0 THEN {made} ELSE text END"


def digests(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    Of ``docs`` (doc_id, text), made periodic by ``with_repetitions`` first. The four
    middle columns are of the longest run (ties: smallest start, then period), else null.
    """
    made = docs.select("doc_id", F.expr(with_repetitions()).alias("text"))
    longest = "array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS q)))"
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"
    return word_runs(made, least, ["doc_id"]).selectExpr(
        "row_.doc_id AS doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", f"{longest} AS best",
        f"sha2(CAST(array_join({lines}, '') AS BINARY), 256) AS runs_sha256",
        "sha2(CAST(collapsed AS BINARY), 256) AS collapsed_sha256",
    ).selectExpr(
        "doc_id", "n_runs", "-best.s AS start", "best.length AS length", "-best.q AS period",
        "1000 * best.length DIV -best.q AS exponent_milli", "runs_sha256", "collapsed_sha256")
