"""Small tables with every awkward row, and plain-Python versions to compare with."""

from __future__ import annotations

import random
import re
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(seed: int, count: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghil") for _ in range(rnd.randint(2, 7)))
                    for _ in range(count))


def edited(text: str, places: list[int]) -> str:
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def awkward() -> list[tuple]:
    """Nulls, empties, short and long texts, ties, exact and near copies, repeated rows."""
    base, other = prose(1, 120), prose(2, 90)
    passage = prose(3, 60)
    return [
        row(1, None), row(2, ""), row(3, " \t\n"), row(4, "One"), row(5, "one"),
        row(6, "two words"), row(7, base), row(8, base.upper()), row(9, base),
        row(10, edited(base, [5])), row(11, edited(base, [5, 60])), row(12, edited(base, [30, 90])),
        row(13, other, None, None), row(13, other, None, None), row(14, other + " " + passage),
        row(15, passage + "\n" + prose(4, 80)), row(16, prose(5, 70) + " " + passage),
        row(17, "Äpfel ÖL ß 你好 😀   end"), row(18, prose(6, 5000), "de", "b"),
        row(None, base), row(None, None), row(19, "x " * 400, "fr", "b"),
        row(20, edited(base, list(range(0, 120, 8)))), row(-3, prose(7, 25)),
    ]


def frame(spark, rows=None):
    """The table, with columns whose names the operators might use themselves."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1 AS n", "'x' AS words", "2 AS rank", "'k' AS key", "0 AS `a.b`")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))


def shingle_set(text: str | None, n: int) -> set[tuple]:
    found = words(text)
    if not found:
        return set()
    return set(zip(*[found[k:] for k in range(n)])) if len(found) >= n else {tuple(found)}


def linked(a: set, b: set, percent: int) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def components(sets: list[tuple[int, set]], percent: int) -> dict[int, int]:
    """Smallest reachable id per id; brute force over all pairs."""
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (i == j and a and b) or linked(a, b, percent):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}
