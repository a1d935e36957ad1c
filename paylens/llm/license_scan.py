"""License scans by a positional index of rare words.

The index lists, for every template, the words of its key phrase with the highest
inverse document frequency and the places they stand at. Postings that agree on
where a template would begin vote for that place, and a place with enough votes is
accepted if the key phrase stands exactly where it has to. Every template has index
words of its own, all of them inside the phrase that must stand, so other notices
in a file take no votes away. Document frequencies are of all documents.
DataFrame and SQL functions only; a row never leaves its task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import computed, let
from .scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_PATTERN = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_RARE = 3  # words of each template that are looked up, its rarest
_VOTES = 0.5  # of the template's places of those

# The phrases that must be found, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # must stand at its place within the text


# Usual one-line notices.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy"
             " of this software and associated documentation files", "hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without"
             " modification are permitted", "source and binary forms"),
    Template("gpl", "this work is licensed under the gnu general public license version 3",
             "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under"
             " the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license",
             "gnu lesser general public license"),
    Template("cc-by", "licensed under cc by nc 4 0", "cc by"),
    Template("cc-by", "this work is licensed under a creative commons attribution license",
             "creative commons attribution"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license",
             "mozilla public license"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
)


def _text(values: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _vocabulary() -> list[str]:
    texts = [t.text for t in TEMPLATES] + list(BASE)
    return sorted({w for t in texts for w in t.split()})


def _worth_reading() -> str:
    """SQL: the text holds a word without which neither phrase nor template can be there."""
    needed = {"cc", "license", "rights", "granted", "redistribution", "commons", "hereby",
              "source"}
    for text in [t.key for t in TEMPLATES] + list(BASE):
        if not needed & set(text.split()):
            raise ValueError(f"no needed word in {text!r}")
    either = "|".join(sorted(needed))
    return f"body rlike '(^|{_SPLIT})({either})({_SPLIT}|$)'"


def _index(idf: dict[str, float]) -> list[tuple[int, int, str]]:
    """(template, place, word) of the words that are looked up."""
    rows = []
    for number, t in enumerate(TEMPLATES):
        rare = sorted(set(t.key.split()), key=lambda w: (-idf[w], w))[:_RARE]
        rows += [(number, place, w) for place, w in enumerate(t.text.split()) if w in rare]
    return rows


def _templates(index: list[tuple[int, int, str]]) -> str:
    rows = []
    for t in TEMPLATES:
        words, key = t.text.split(), t.key.split()
        at = next(k for k in range(len(words)) if words[k:k + len(key)] == key)
        # Only the places inside the key phrase are sure to be there.
        sure = sum(1 for n, place, _ in index if TEMPLATES[n] is t and at <= place < at + len(key))
        rows.append(f"struct('{t.label}' AS label, {_text(words)} AS words, {at} AS key_at,"
                    f" {_text(key)} AS key, {math.ceil(_VOTES * sure)} AS votes)")
    return f"array({', '.join(rows)})"


def _base_places() -> str:
    found = []
    for phrase, label in BASE.items():
        first, *rest = phrase.split()
        tests = " AND ".join([f"h.w = '{first}'"] + [
            f"get(words, h.i + {k}) <=> '{w}'" for k, w in enumerate(rest, 1)])
        found.append(f"transform(filter(hits, h -> {tests}), h -> struct(h.i AS i,"
                     f" '{label}' AS label))")
    return f"concat({', '.join(found)})"


def _document_frequencies(bodies: DataFrame, scratch: Scratch) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each licence word; as many rows as there are such words."""
    present = bodies.select(F.expr(
        f"array_intersect(regexp_extract_all(body, '{_PATTERN}', 0), {_text(_vocabulary())})"
    ).alias("w"))
    counts = present.select(F.explode("w").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n"))
    counts = scratch.save(counts, "frequencies")
    return bodies.count(), {r.w: r.n for r in counts.collect()}


def scanned(docs: DataFrame) -> DataFrame:
    """``row_`` (all columns), n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII.
    n_base counts all places where a base phrase stands word for word, first_word and
    last_word are the smallest and largest, from 0, null without one. labels are those
    of base phrases and of accepted templates; both lists are distinct, sorted and
    comma-joined, empty without any. score is the largest share of a template's words
    found at its accepted place; 0.5 with base phrases alone, else 0.

    Null and empty texts have no words. Rows are independent, so nulls, repeated rows
    and other columns of any name pass; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
        F.expr(f"translate(coalesce(CAST(text AS STRING), ''), '{_UPPER}', '{_LOWER}')")
        .alias("body"))
    total, df_of = _document_frequencies(df.select("body"), scratch)
    idf = {w: math.log((total + 1) / (df_of.get(w, 0) + 1)) for w in _vocabulary()}
    ranked = sorted(idf, key=lambda w: (-idf[w], w))

    hits = f"filter(transform(words, (w, i) -> struct(i, w)), x -> array_contains({_text(ranked)}, x.w))"
    index = _index(idf)
    postings = "array(" + ", ".join(
        f"struct({t} AS t, {place} AS at, '{w}' AS w)" for t, place, w in index) + ")"
    looked_up = _text(sorted({w for _, _, w in index}))
    votes = (f"flatten(transform(filter(hits, h -> array_contains({looked_up}, h.w)), h -> transform("
             f"filter({postings}, p -> p.w = h.w), p -> struct(p.t AS t, h.i - p.at AS at))))")
    words_of = "templates[v.t].words"
    enough = "size(filter(votes, x -> x = v)) >= templates[v.t].votes"
    phrase = ("v.at + templates[v.t].key_at >= 0 AND slice(words, v.at + templates[v.t].key_at + 1,"
              " size(templates[v.t].key)) = templates[v.t].key")
    share = (f"size(filter(transform({words_of}, (w, k) -> v.at + k >= 0 AND get(words, v.at + k)"
             f" <=> w), x -> x)) / CAST(size({words_of}) AS DOUBLE)")
    accepted = (f"transform(filter(array_distinct(votes), v -> ({phrase}) AND {enough}),"
                f" v -> struct(templates[v.t].label AS label, {share} AS share))")
    labels = ("array_join(array_sort(array_distinct(concat(transform(base, b -> b.label),"
              " transform(accepted, x -> x.label)))), ',')")
    made = f"""struct(CAST(size(words) AS BIGINT) AS n_words, CAST(size(base) AS BIGINT) AS n_base,
        CAST(array_min(transform(base, b -> b.i)) AS BIGINT) AS first_word,
        CAST(array_max(transform(base, b -> b.i)) AS BIGINT) AS last_word,
        array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') AS base_labels,
        {labels} AS labels,
        coalesce(array_max(transform(accepted, x -> x.share)),
                 CASE WHEN size(base) > 0 THEN 0.5D ELSE 0.0D END) AS score)"""
    for name, value in (("accepted", accepted), ("templates", _templates(index)), ("votes", votes),
                        ("base", _base_places()), ("hits", hits)):
        made = let(name, value, made)
    nothing = """struct(CAST(size(words) AS BIGINT) AS n_words, 0L AS n_base,
        CAST(NULL AS BIGINT) AS first_word, CAST(NULL AS BIGINT) AS last_word,
        '' AS base_labels, '' AS labels, 0.0D AS score)"""
    either = f"CASE WHEN {_worth_reading()} THEN {made} ELSE {nothing} END"
    return computed(df, ["row_"], let("words", f"regexp_extract_all(body, '{_PATTERN}', 0)", either))


def brute_words(text: str | None) -> list[str]:
    """The words of a text, for comparison in tests."""
    folded = (text or "").translate(str.maketrans(_UPPER, _LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
