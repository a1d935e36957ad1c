"""CSV files with line breaks inside quotes, read by many tasks.

A line break ends a record if the quotes before it are even in number. Files are split by
bytes as text files are, quotes are counted per split, and a running sum over the splits of
a file says with which parity each begins. Every task then joins the lines of its records;
what runs over the end of a split, a piece or two per split, is put together afterwards.
A quote inside a field must be doubled, and a field that holds one quoted, as the format has
it; a file with an odd number of quotes stops the load.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _HEAD, _TAIL = 0, 1, 2  # a record; the end of one begun before; the begin of one
_PIECES = "file string, start long, kind int, text string"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their file and the byte at which their split begins, in order per split."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value"))


def _parities(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins inside quotes, and whether its file is left open."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("file")
    return splits.select(
        "file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("n").over(all_) % 2 == 1).alias("odd"))


def _pieces_of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, value, inside) in the order of each split, to records and pieces."""
    held, at, odd, fresh = [], None, False, True  # lines of an unfinished record

    def out(kinds, texts):
        n = len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()),
             pa.array(kinds, pa.int32()), pa.array(texts, pa.string())],
            names=["file", "start", "kind", "text"])

    def rest():
        return out([_HEAD if fresh else _TAIL], ["\n".join(held)])

    for batch in batches:
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        edges = np.flatnonzero(np.concatenate(
            ([True], starts[1:] != starts[:-1])) | _changes(files))
        for first, past in zip(edges, [*edges[1:], batch.num_rows]):
            here = (files[int(first)].as_py(), int(starts[first]))
            if here != at:
                if held:
                    yield rest()
                at, held, fresh = here, [], bool(batch.column("inside")[int(first)].as_py())
                odd = fresh
            values = batch.column("value").slice(first, past - first)
            counts = pc.count_substring(values, '"').to_numpy()
            after = (np.cumsum(counts) + odd) % 2 == 1  # inside quotes behind each line
            odd = bool(after[-1])
            closes = np.flatnonzero(~after)
            if not len(closes):
                held += values.to_pylist()
                continue
            bounds = np.concatenate(([0], closes + 1)).astype(np.int32)
            inner = values.slice(0, int(bounds[-1]))
            if isinstance(inner, pa.ChunkedArray):
                inner = inner.combine_chunks()
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), inner), "\n")
            texts = texts.to_pylist()
            if held:
                texts[0] = "\n".join([*held, texts[0]])
            kinds = [_WHOLE] * len(texts)
            if fresh:
                kinds[0] = _HEAD
            yield out(kinds, texts)
            fresh, held = False, values.slice(int(bounds[-1])).to_pylist()
    if held:
        yield rest()


def _changes(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode().indices.to_numpy()
    return np.concatenate(([False], codes[1:] != codes[:-1]))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, start, text): every record of the files, its header among them."""
    lines = _lines(spark, paths)
    # One row per split, a hundred bytes for every hundred megabytes of text.
    known = lines.join(F.broadcast(_parities(lines)), ["file", "start"])
    complaint = F.concat(F.lit("odd number of quotes in "), F.col("file"))
    inside = F.when(F.col("odd"), F.raise_error(complaint).cast("boolean")).otherwise(
        F.col("inside"))
    pieces = known.select("file", "start", "value", inside.alias("inside")).mapInArrow(
        _pieces_of_task, _PIECES)
    # Pieces at the borders of splits, in order: a begin, then all that follows up to the next.
    order = Window.partitionBy("file").orderBy("start", "kind")
    begun = F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order)
    cut = pieces.where(F.col("kind") != _WHOLE).withColumn("record", begun)
    glued = cut.groupBy("file", "record").agg(
        F.min("start").alias("start"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("start", "kind", "text"))),
            lambda p: p.text), "\n").alias("text"))
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "start", "text")
    found = whole.unionByName(glued.select("file", "start", "text"))
    return found.withColumn("text", F.regexp_replace("text", "\r$", ""))


def read(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The rows of files that all have these columns in this order, every column as text."""
    kinds = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    header = F.from_csv("text", kinds, {"escape": '"', "mode": "FAILFAST"})
    rows = records(spark, paths).where("text <> ''").select("start", header.alias("r"))
    is_header = F.lit(True)
    for name in columns:
        is_header = is_header & F.col("r").getField(name).eqNullSafe(F.lit(name))
    return rows.where(~((F.col("start") == 0) & is_header)).select("r.*")
