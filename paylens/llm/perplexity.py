"""Quality by perplexity under a modified Kneser-Ney model of trusted text.

``classified`` scores documents by the model of ``character_model`` and gives each
language its threshold from trusted documents that the model has not seen.

``counted``, ``model_tables`` and ``scored`` are a smaller model, which ``classified``
does not use. It reads 64 character classes (letters by case, blanks, digits, kinds of
punctuation), so an n-gram of order four is a number below 2**24 and every table is
bounded, but all letters from U+0250 on are the same to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .character_model import perplexities
from .scratch import Scratch

ORDER = 4
_BITS = 6
_CHUNK = 2 << 20  # characters counted at a time
_START = 0


def _class_table() -> np.ndarray:
    """Class of every character below 0x250, case-sensitive for letters."""
    table = np.zeros(0x251, np.uint8)
    for code in range(0x250):
        char = chr(code)
        if "a" <= char <= "z":
            kind = 1 + code - 97
        elif "A" <= char <= "Z":
            kind = 27 + code - 65
        elif char == "\n":
            kind = 53
        elif char.isspace():
            kind = 54
        elif char.isdigit():
            kind = 55
        elif char in ".,;:":
            kind = 56
        elif char in "!?":
            kind = 57
        elif char in "'\"()-":
            kind = 58
        elif char.isalpha():
            kind = 59 if char.islower() else 60
        else:
            kind = 61
        table[code] = kind
    table[0x250] = 62  # all other characters
    return table


_CLASSES = _class_table()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram number at every character of some texts, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASSES[np.minimum(points, 0x250)].astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(len(points)) - np.repeat(offsets[:-1], sizes)
    codes = kinds.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(kinds)
        before[back:] = kinds[:-back] if back < len(kinds) else 0
        before[place < back] = _START
        codes |= before << (_BITS * back)
    return codes, offsets


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= _CHUNK or k + 1 == len(texts):
            yield first, texts[first:k + 1]
            first, held = k + 1, 0


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _chunks(batch, "text"):
            codes, counts = np.unique(_codes(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))],
                names=["gram", "n"])


def counted(texts: DataFrame) -> DataFrame:
    """(gram, n) of the highest order over all rows of ``texts`` (text)."""
    return texts.select("text").mapInArrow(_count, "gram long, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the counts of counts."""
    row = grams.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]  # too little text for estimates
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1)]


def model_tables(top: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1 up: (gram, p) of the seen n-grams and (context, gamma).

    Lower orders count in how many contexts an n-gram occurs, as Kneser-Ney does.
    """
    grams = [top]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << (_BITS * order)) - 1)
        grams.insert(0, scratch.save(
            grams[0].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")),
            f"grams-{order}"))
    made: list[tuple[DataFrame, DataFrame]] = []
    for order, held in enumerate(grams, 1):
        d1, d2, d3 = _discounts(held)
        held = held.withColumn("context", F.shiftright("gram", _BITS))
        around = held.groupBy("context").agg(
            F.sum("n").alias("total"),
            F.expr(f"sum(CASE WHEN n = 1 THEN {d1}D WHEN n = 2 THEN {d2}D ELSE {d3}D END)")
            .alias("taken"))
        around = scratch.save(around.select(
            "context", "total", F.expr("taken / total").alias("gamma")), f"contexts-{order}")
        met = held.join(around, "context").withColumn("own", F.expr(
            f"(n - CASE WHEN n = 1 THEN {d1}D WHEN n = 2 THEN {d2}D ELSE {d3}D END) / total"))
        if order == 1:
            met = met.withColumn("p", F.expr(f"own + gamma / {1 << _BITS}D"))
        else:
            lower = made[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            met = met.withColumn("suffix", F.col("gram").bitwiseAND(
                (1 << (_BITS * (order - 1))) - 1)).join(lower, "suffix").withColumn(
                "p", F.expr("own + gamma * below"))
        made.append((scratch.save(met.select("gram", "p"), f"order-{order}"),
                     around.select("context", "gamma")))
    return made


def _dense(tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Log probability of every possible n-gram of the highest order."""
    below = np.full(1, -np.log(1 << _BITS))
    for order, (grams, p, contexts, gamma) in enumerate(tables, 1):
        weight = np.zeros(1 << (_BITS * (order - 1)), np.float32)  # log 1: unseen context
        weight[contexts] = np.log(gamma)
        if order == 1:
            logs = np.full(1 << _BITS, weight[0] + below[0], np.float32)
        else:
            # gram = context, class; what is below it is its suffix.
            logs = np.tile(below.reshape(-1, 1 << _BITS), (1 << _BITS, 1)) \
                .reshape(-1, 1 << _BITS) + weight[:, None]
            logs = logs.reshape(-1)
        logs[grams] = np.log(p)
        below = logs.astype(np.float32)
    return below


def scored(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc_id, lang, perplexity) for every row; null for null and empty texts."""
    held = []
    for grams, contexts in tables:  # at most 64 ** 4 numbers, whatever the corpus
        a, b = grams.toArrow(), contexts.toArrow()
        held.append((a.column("gram").to_numpy(), a.column("p").to_numpy(),
                     b.column("context").to_numpy(), b.column("gamma").to_numpy()))
    shared = docs.sparkSession.sparkContext.broadcast(held)
    dense: list[np.ndarray] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not dense:
            dense.append(_dense(shared.value))
        for batch in batches:
            found = np.full(batch.num_rows, np.nan)
            for first, texts in _chunks(batch, "text"):
                codes, offsets = _codes(texts)
                logs = np.concatenate((dense[0][codes], np.zeros(1, np.float32)))
                sums = np.add.reduceat(logs, offsets[:-1], dtype=np.float64)
                sizes = np.diff(offsets)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found[first:first + len(texts)] = np.where(
                        sizes > 0, np.exp(-sums / sizes), np.nan)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"),
                 pa.array(found, mask=np.isnan(found))], names=["doc_id", "lang", "perplexity"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang string, perplexity double")


def classified(docs: DataFrame, labels: DataFrame, quantile: float = 0.99,
               margin: float = 1.15, held_out: int = 10) -> DataFrame:
    """(doc_id, perplexity, threshold, kept) for every row of ``docs``.

    docs: (doc_id, text, lang, ...); labels: (doc_id, quality, ...), quality 1 marks
    trusted documents. One in ``held_out`` trusted documents, by a hash of doc_id, is not
    counted in the model. threshold: ``margin`` times the ``quantile`` of those of the
    language, or of all languages where one (or null) has none, or of all trusted ones
    where there are none. A document is kept up to the threshold; with no trusted
    document at all every text is kept. Null and empty texts have no perplexity and are not kept. Rows without
    doc_id are scored; repeated rows each count; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "perplexity")
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    apart = F.expr(f"pmod(xxhash64(doc_id), {held_out}) = 0")
    scores = scratch.save(perplexities(docs, trusted.where(~apart), scratch), "scores")
    known = scores.where("perplexity IS NOT NULL").join(trusted, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin
    unseen = known.where(apart)
    own = unseen.groupBy(F.col("lang").alias("l")).agg(at.alias("own"))
    whole = unseen.agg(at).first()[0] or known.agg(at).first()[0]
    met = scores.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn(
        "threshold", F.coalesce("own", F.lit(whole).cast("double")))
    return met.select("doc_id", "perplexity", "threshold", F.expr(
        "perplexity IS NOT NULL AND coalesce(perplexity <= threshold, true)").alias("kept"))
