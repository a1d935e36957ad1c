"""Modified Kneser-Ney over the characters of trusted text, joined in shards.

An n-gram of order four is a context of three characters, 21 bits each in one number,
and the character after it: every character of every script is itself. Documents are
dealt to chunks of some megabytes. Each chunk gives its different n-grams once, with
their counts in trusted documents; tables of n-grams, contexts and suffixes are joined
by hash partitions, to the model and then to the n-grams that the documents need; the
probabilities go back to the chunks, which sum their logarithms per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mixed
from .scratch import Scratch

ORDER = 4
CHUNK_ROWS = 8_000
_BITS = 21
_BEFORE = 0x110000  # stands before the first character of a text
_WINDOW = 1 << 20  # characters taken at a time
_WORD = np.uint64(0x9E3779B97F4A7C15)


def _slices(texts: pa.ChunkedArray) -> Iterator[tuple[int, list[str]]]:
    """Texts of about a window of characters together, with the number of the first."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts, 1):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= _WINDOW or k == len(texts):
            yield first, held
            held, size, first = [], 0, k


class _Texts:
    """The characters of some texts, and where each begins."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer(
            "".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, context, last) of the n-gram that ends at each character."""
        for low in range(0, len(self.points), _WINDOW):
            high = min(low + _WINDOW, len(self.points))
            held = np.diff(np.clip(self.offsets, low, high))
            text = np.repeat(np.arange(len(held)), held)
            place = np.arange(low, high) - self.offsets[text]
            context = np.zeros(high - low, np.int64)
            for back in range(1, ORDER):
                before = np.full(high - low, _BEFORE, np.int64)
                skip = max(back - low, 0)
                before[skip:] = self.points[low + skip - back:max(high - back, 0)]
                before[place < back] = _BEFORE
                context |= before << (_BITS * (back - 1))
            yield text, context, self.points[low:high]


def _different(context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (context, last), and for each row which of them it is."""
    contexts = pa.array(context).dictionary_encode()
    which = contexts.indices.to_numpy().astype(np.int64)
    both = pa.array(which << _BITS | last).dictionary_encode()
    made = both.dictionary.to_numpy()
    return (contexts.dictionary.to_numpy()[made >> _BITS], made & ((1 << _BITS) - 1),
            both.indices.to_numpy())


def _grams(texts: pa.ChunkedArray, trusted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (context, last, n) of all texts; n counts the trusted ones."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for first, held in _slices(texts):
        slice_ = _Texts(held)
        for text, context, last in slice_.windows():
            context, last, which = _different(context, last)
            parts.append((context, last, np.bincount(
                which, weights=trusted[first + text], minlength=len(last)).astype(np.int64)))
    context, last, n = (np.concatenate(x) for x in zip(*parts))
    context, last, which = _different(context, last)
    return context, last, np.bincount(which, weights=n, minlength=len(last)).astype(np.int64)


def _counted(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """(chunk, context, last, n) of a chunk; n counts the documents that are trusted."""
    docs = docs.combine_chunks()
    ids = pa.array(trusted.column("doc_id").to_numpy())
    own = pc.is_in(docs.column("doc_id"), value_set=ids, skip_nulls=True).to_numpy()
    context, last, n = _grams(docs.column("text"), own.astype(np.float64))
    chunk = np.full(len(n), docs.column("chunk")[0].as_py() if docs.num_rows else 0, np.int64)
    return pa.table({"chunk": chunk, "context": context, "last": last, "n": n})


def _key(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(mixed(context.view(np.uint64)) + last.view(np.uint64) * _WORD)


def _summed(docs: pa.Table, found: pa.Table) -> pa.Table:
    """(doc_id, lang, perplexity) of the documents of a chunk, from (context, last, p)."""
    docs = docs.combine_chunks()
    keys = _key(found.column("context").to_numpy(), found.column("last").to_numpy())
    order = np.argsort(keys)
    keys, logs = keys[order], np.log(found.column("p").to_numpy())[order]
    perplexity = np.full(docs.num_rows, np.nan)
    for first, held in _slices(docs.column("text")):
        texts = _Texts(held)
        sums = np.zeros(len(held))
        for text, context, last in texts.windows():
            context, last, which = _different(context, last)
            sums += np.bincount(
                text, weights=logs[np.searchsorted(keys, _key(context, last))][which],
                minlength=len(sums))
        with np.errstate(divide="ignore", invalid="ignore"):
            perplexity[first:first + len(held)] = np.exp(-sums / texts.sizes)
    return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"),
                     "perplexity": pa.array(perplexity, mask=np.isnan(perplexity))})


def _shorter(order: int) -> Column:
    """The context that an n-gram of ``order`` has in the next lower order."""
    return F.col("context").bitwiseAND((1 << (_BITS * (order - 2))) - 1)


def _discounts(grams: DataFrame) -> DataFrame:
    """One row with D1, D2 and D3+ from the counts of counts; constants on too little text."""
    counts = grams.agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}")
                         for k in (1, 2, 3, 4)])
    y = "n1 / (n1 + 2 * n2)"
    raw = (f"1 - 2 * {y} * n2 / n1", f"2 - 3 * {y} * n3 / n2", f"3 - 4 * {y} * n4 / n3")
    return counts.select(*[F.expr(
        f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN least(greatest({d}, 0.1D), {k} - 0.05D)"
        f" ELSE {few}D END").alias(f"d{k}") for k, (d, few) in enumerate(zip(raw, (0.5, 0.75, 0.9)), 1)])


def _tables(top: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1 up: (context, last, own) and (context, gamma).

    Lower orders count in how many contexts an n-gram occurs, as Kneser-Ney does.
    """
    grams = [scratch.save(top, f"grams-{ORDER}")]
    for order in range(ORDER, 1, -1):
        grams.insert(0, scratch.save(
            grams[0].select(_shorter(order).alias("context"), "last")
            .groupBy("context", "last").agg(F.count(F.lit(1)).alias("n")), f"grams-{order - 1}"))
    made = []
    for order, held in enumerate(grams, 1):
        cut = held.crossJoin(F.broadcast(_discounts(held))).withColumn(
            "d", F.expr("CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END"))
        around = cut.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        own = cut.join(around, "context").select(
            "context", "last", F.expr("(n - d) / total").alias("own"))
        made.append((scratch.save(own, f"own-{order}"), scratch.save(
            around.select("context", F.expr("taken / total").alias("gamma")), f"gamma-{order}")))
    return made


def _looked_up(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]],
               scratch: Scratch) -> DataFrame:
    """(context, last, p) of the n-grams of the highest order in ``wanted``."""
    needed = [scratch.save(wanted.select("context", "last").distinct(), f"needed-{ORDER}")]
    for order in range(ORDER, 1, -1):
        needed.insert(0, scratch.save(needed[0].select(
            _shorter(order).alias("context"), "last").distinct(), f"needed-{order - 1}"))
    # One share more than there are characters is left for the characters not seen.
    below = tables[0][0].agg((1 / (F.count(F.lit(1)) + 1)).alias("below"))
    found = needed[0].crossJoin(F.broadcast(below))
    for order, (grams, contexts) in enumerate(tables, 1):
        if order > 1:
            lower = found.select(F.col("context").alias("shorter"), "last",
                                 F.col("p").alias("below"))
            found = needed[order - 1].withColumn("shorter", _shorter(order)).join(
                lower, ["shorter", "last"]).drop("shorter")
        found = found.join(grams, ["context", "last"], "left").join(contexts, "context", "left")
        found = scratch.save(found.select("context", "last", F.expr(
            "coalesce(own, 0D) + coalesce(gamma, 1D) * below").alias("p")), f"found-{order}")
    return found


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang, perplexity) of every row of ``docs``; null for null and empty texts.

    docs: (doc_id, text, lang, ...); trusted: (doc_id), whose documents the model counts.
    Rows of one doc_id are in one chunk, rows without doc_id are dealt by their text.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
    chunks = narrow.count() // CHUNK_ROWS + 1
    chunk = f"pmod(xxhash64(doc_id), {chunks})"
    dealt = narrow.withColumn("chunk", F.expr(
        f"CASE WHEN doc_id IS NULL THEN pmod(xxhash64(text), {chunks}) ELSE {chunk} END"))
    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where(
        "doc_id IS NOT NULL").withColumn("chunk", F.expr(chunk))
    by_chunk = dealt.groupBy("chunk")
    grams = scratch.save(by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(
        _counted, "chunk long, context long, last long, n long"), "grams")
    top = grams.where("n > 0").groupBy("context", "last").agg(F.sum("n").alias("n"))
    found = _looked_up(grams, _tables(top, scratch), scratch)
    met = grams.drop("n").join(found, ["context", "last"])
    return by_chunk.cogroup(met.select("chunk", "context", "last", "p").groupBy("chunk")) \
        .applyInArrow(_summed, "doc_id long, lang string, perplexity double")
