"""Language identification by words first, character n-grams where a word is unknown.

Every learned language has log frequencies of whole words; a word that no language
has seen is scored by its character n-grams, per place by the longest one known,
from five letters down to one. Both tables are trained on labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_per_group
from .scratch import Scratch

_WORD = re.compile(r"[^\W\d_]+")
_ORDER = 5
_REMEMBERED = 200_000


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Signs such as a raised 2 may stand in one, not make one."""
    if not text:
        return []
    return [w for w in _WORD.findall(text.lower())
            if w.isalpha() or any(c.isalpha() for c in w)]


def grams(word: str) -> Iterator[str]:
    """All character n-grams of the word with its borders, 1 to 5 long."""
    edged = f" {word} "
    for n in range(1, _ORDER + 1):
        for k in range(len(edged) - n + 1):
            yield edged[k:k + n]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to partial counts (lang, kind, item, n); kind 0 is a word."""
    found: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            parts = Counter()
            for word, n in words.items():
                for g in grams(word):
                    parts[g] += n
            for kind, counter in ((0, words), (1, parts)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()),
                     pa.array([kind] * len(counter), pa.int32()),
                     pa.array(list(counter), pa.string()),
                     pa.array(list(counter.values()), pa.int64())],
                    names=["lang", "kind", "item", "n"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(lang, Counter()).update(letters(text))
        if sum(map(len, found.values())) > _REMEMBERED:  # bounds the worker's memory
            yield from flush()
    yield from flush()


class Table:
    """Log frequencies: a row of ``logs`` per known item, a column per language."""

    def __init__(self, items: list[str], counts: np.ndarray):
        totals = np.maximum(counts.sum(axis=0), 1.0)
        self.rows = {item: k for k, item in enumerate(items)}
        self.logs = np.log((counts + 0.5) / (totals + 0.5 * max(1, len(items))))


class Model:
    """Looks words up and backs off to n-grams."""

    def __init__(self, langs: list[str], words: Table, parts: Table):
        self.langs, self.words, self.parts = langs, words, parts
        self._known: dict[str, np.ndarray] = {}

    def _backed_off(self, word: str) -> np.ndarray:
        """Mean over the places of a word of the longest known n-gram that ends there."""
        edged, rows = f" {word} ", self.parts.rows
        found = []
        for end in range(2, len(edged) + 1):
            for n in range(min(_ORDER, end), 0, -1):
                row = rows.get(edged[end - n:end])
                if row is not None:
                    found.append(row)
                    break
        return self.parts.logs[found].mean(axis=0) if found else np.zeros(len(self.langs))

    def _score(self, word: str) -> np.ndarray:
        row = self._known.get(word)
        if row is None:
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            row = self._known[word] = self._backed_off(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        counted = Counter(letters(text))
        if not counted or not self.langs:
            return "und", 0.0
        rows, times, total = [], [], np.zeros(len(self.langs))
        for word in sorted(counted):
            row = self.words.rows.get(word)
            if row is None:
                total = total + counted[word] * self._score(word)
            else:
                rows.append(row)
                times.append(counted[word])
        if rows:
            total = total + np.array(times, float) @ self.words.logs[rows]
        shares = np.exp(np.clip(total - total.max(), -700, 0))
        best = int(np.argmax(total))  # the alphabetically first among equals
        return self.langs[best], float(shares[best] / shares.sum())


def train(labelled: DataFrame, max_rows: int = 5_000, max_items: int = 25_000) -> Model:
    """Fits a model on rows (doc_id, lang, text).

    Of every language about ``max_rows`` rows are used (all, if fewer), chosen by a hash of
    doc_id and text, and the ``max_items`` words and as many n-grams that are most frequent
    in it. So a rare language is learned like a common one, and what reaches the driver and
    the tasks is bounded for each language, whatever the table. A rarer word is not known as
    a word and backs off to its n-grams.
    """
    scratch = Scratch(labelled.sparkSession, "language")
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    langs = sorted(r.lang for r in sizes.collect())  # one row per language
    chosen = known.join(F.broadcast(sizes), "lang").where(
        f"pmod(h, 1000000007) < least(1D, {max_rows}D / size) * 1000000007D"
    ).select("lang", "text")
    counted = scratch.save(
        chosen.repartition("lang", "text").mapInArrow(
            _counts, "lang string, kind int, item string, n long"
        ).groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")), "counted")
    often = top_per_group(counted, ["kind", "lang"], [F.desc("n"), F.col("item")], max_items)
    wide = counted.join(often.select("kind", "item").distinct(), ["kind", "item"], "left_semi") \
        .groupBy("kind", "item").agg(*[
            F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}")
            for k, lang in enumerate(langs)], F.lit(0).alias("n"))
    held = wide.toArrow()
    tables = []
    for kind in (0, 1):
        best = held.filter(pc.field("kind") == kind).sort_by("item")
        counts = [best.column(f"n{k}").to_numpy() for k in range(len(langs))]
        tables.append(Table(best.column("item").to_pylist(),
                            np.array(counts, float).reshape(len(langs), best.num_rows).T))
    scratch.drop("counted")
    return Model(langs, *tables)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text, ...).

    The prediction reads the text alone. Null texts and texts without a letter are
    ``und`` with score 0, as is everything under a model without languages. score is
    the share of the best language in the sum of likelihoods. Repeated rows, null ids
    and other columns do not matter; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.parts))
    held: list[Model] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Model(*shared.value))
        for batch in batches:
            made = [held[0].predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


HELD_OUT = "pmod(crc32(CAST(doc_id AS STRING)), 3) = 1"
