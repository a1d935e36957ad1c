"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few whole-number measures. Their distribution within a
(language, source) group is held in a mergeable quantile sketch: counts in
buckets that are exact below 64 and at most 1/32 wide above, so any partial
sketches add up to the same whole in any order. Fences around the quartiles,
widened by a fixed slack, replace fixed cut-offs; groups with few documents use
the merged sketch of their language, then that of the table. The fences are
joined back to the documents. DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import computed, let
from .scratch import Scratch

_BLANKS = r"' \t\n\u000B\u000C\r'"
_BROADCAST_GROUPS = 50_000  # fences of that many groups stay below 10 MB


@dataclass(frozen=True)
class Fence:
    """A document fails above Q3 + reach (Q3 - Q1) + slack, or below the mirror of it."""

    name: str
    per_mille: str  # SQL over the measures
    slack: int
    reach: int = 3
    low: bool = False  # also check the lower side


FENCES = (
    Fence("symbols", "n_symbols * 1000 div n_words", 200),
    Fence("capitals", "n_capitals * 1000 div word_chars", 100),
    Fence("repeated_lines", "n_dup_lines * 1000 div n_lines", 400),
    Fence("word_length", "word_chars * 1000 div n_words", 1500, low=True),
)


def _light(docs: DataFrame, with_words: bool) -> DataFrame:
    """``row_`` (all columns), and the measures that need no windows of words."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    capitals = "translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')"
    made = f"""struct({"words," if with_words else ""}
        CAST(size(words) AS BIGINT) AS n_words,
        CAST(length(translate(body, {_BLANKS}, '')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(length(body) - length({capitals}) AS BIGINT) AS n_capitals,
        CAST(size(lines) AS BIGINT) AS n_lines,
        CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines)"""
    made = let("lines", f"filter(split(body, '\\n', -1), l -> translate(l, {_BLANKS}, '') <> '')",
                made)
    made = let("words", r"regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+', 0)", made)
    return computed(df, ["row_"], made)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 8-word windows that occur twice or more.

    Window hashes come from hashes of one, two and four words, by doubling.
    """
    def doubled(half: str, step: int, count: int) -> str:
        return (f"zip_with(slice({half}, 1, size(words) - {count}),"
                f" slice({half}, {1 + step}, size(words) - {count}), (a, b) -> xxhash64(a, b))")

    covered = ("aggregate(again, struct(-8 AS last, 0L AS n),"
               " (a, i) -> struct(i AS last, a.n + least(8, i - a.last) AS n), a -> a.n)")
    again = ("sort_array(filter(transform(spots, (s, k) -> CASE WHEN get(spots, k - 1).h <=> s.h"
             " OR get(spots, k + 1).h <=> s.h THEN s.i ELSE -1 END), i -> i >= 0))")
    spots = "sort_array(transform(eight, (h, i) -> struct(h AS h, i AS i)))"
    count = let("spots", spots, let("again", again, covered))
    count = f"CASE WHEN size(array_distinct(eight)) < size(eight) THEN {count} ELSE 0L END"
    count = let("eight", doubled("four", 4, 7), count)
    count = let("four", doubled("two", 2, 3), count)
    count = let("two", doubled("one", 1, 1), count)
    count = let("one", "transform(words, w -> xxhash64(w))", count)
    count = f"CASE WHEN size(words) >= 8 THEN {count} ELSE 0L END"
    rest = [c for c in df.columns if c != "words"]
    return computed(df, rest, f"struct({count} AS n_repeat_words)")


def _per_mille(fence: Fence) -> str:
    return f"CASE WHEN n_words > 0 THEN {fence.per_mille} ELSE 0L END"


def _thresholds(light: DataFrame, fences: Sequence[Fence], min_rows: int) -> DataFrame:
    """(lang, source) with ``low_<fence>`` and ``high_<fence>``."""
    values = ", ".join(f"'{f.name}', {_per_mille(f)}" for f in fences)
    long = light.where("n_words >= 20").select(
        F.expr("CAST(row_.lang AS STRING)").alias("lang"),
        F.expr("CAST(row_.source AS STRING)").alias("source"),
        F.expr(f"stack({len(fences)}, {values})").alias("fence", "v"))
    bits = "greatest(length(bin(v)) - 6, 0)"
    sketch = long.withColumn("bucket", F.expr(f"shiftleft(shiftright(v, {bits}), {bits})")) \
        .groupBy("lang", "source", "fence", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # Merging: the same buckets, added up over sources, then over languages.
    levels = sketch.select(
        F.expr("stack(3, 'group', lang, source, 'lang', lang, NULL, 'all', NULL, NULL)")
        .alias("level", "l", "s"), "fence", "bucket", "n",
    ).groupBy("level", "l", "s", "fence", "bucket").agg(F.sum("n").alias("n"))
    # A sketch has at most some hundred buckets, whatever the number of documents.
    quartiles = levels.groupBy("level", "l", "s", "fence").agg(
        F.sum("n").alias("size"),
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("held"))

    def quantile(quarters: int) -> str:
        return ("aggregate(held, struct(0L AS seen, CAST(NULL AS BIGINT) AS at), (a, b) -> struct("
                "a.seen + b.n AS seen, coalesce(a.at, CASE WHEN (a.seen + b.n) * 4 >="
                f" size * {quarters} THEN b.bucket END) AS at), a -> a.at)")

    marks = quartiles.select("level", "l", "s", "fence", "size",
                             F.expr(quantile(1)).alias("q1"), F.expr(quantile(3)).alias("q3"))
    mark = F.struct("size", "q1", "q3")
    group = marks.where("level = 'group'").select(
        F.col("l").alias("lang_"), F.col("s").alias("source_"), "fence", mark.alias("g"))
    lang = marks.where("level = 'lang'").select("l", F.col("fence").alias("f"), mark.alias("m"))
    whole = marks.where("level = 'all'").select("fence", mark.alias("w"))
    joined = group.join(lang, group.lang_.eqNullSafe(lang.l) & (group.fence == lang.f)) \
        .join(whole, "fence")
    chosen = F.expr(f"CASE WHEN g.size >= {min_rows} THEN g WHEN m.size >= {min_rows} THEN m"
                    " ELSE w END")
    return joined.withColumn("c", chosen).groupBy("lang_", "source_").agg(*[
        F.max(F.when(F.col("fence") == f.name, F.expr(
            f"struct(c.q1 - {f.reach} * (c.q3 - c.q1) - {f.slack} AS low,"
            f" c.q3 + {f.reach} * (c.q3 - c.q1) + {f.slack} AS high)"))).alias(f"fence_{f.name}")
        for f in fences])


def measured(docs: DataFrame, fences: Sequence[Fence] = FENCES, min_rows: int = 100) -> DataFrame:
    """``row_`` (a struct of all columns of ``docs``), the measures, and the verdict.

    docs: (text, lang, source, ...); other columns of any name are carried along.
    base_failed: fewer than 20 words, or over 30 % of them in repeated windows.
    kept: not base_failed, and inside every fence. The sketches are of all documents
    with 20 words or more; groups below ``min_rows`` of them use merged sketches.

    A null text has no words and fails. Null languages and sources are groups of
    their own. Repeated rows each count. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    limits = scratch.save(_thresholds(_light(docs, False), fences, min_rows), "fences")
    if limits.count() <= _BROADCAST_GROUPS:  # else a shuffled join, which can be split
        limits = F.broadcast(limits)
    full = _with_repeats(_light(docs, True))
    met = full.join(
        limits, F.expr("CAST(row_.lang AS STRING) <=> lang_ AND"
                       " CAST(row_.source AS STRING) <=> source_"), "left")
    passed = " AND ".join(
        f"coalesce({_per_mille(f)} <= fence_{f.name}.high"
        + (f" AND {_per_mille(f)} >= fence_{f.name}.low" if f.low else "") + ", true)"
        for f in fences)
    met = met.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return met.withColumn("kept", F.expr(f"NOT base_failed AND {passed}")).select(
        "row_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return measured(docs).where("kept").select("row_.*")
