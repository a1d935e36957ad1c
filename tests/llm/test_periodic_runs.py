import hashlib
import random
import re
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest

from paylens.llm import periodic_runs
from paylens.llm.periodic_runs import Extensions, digests, runs, word_runs


def brute_runs(words, least):
    """All runs by comparing every pair of words one period apart."""
    best, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                best.setdefault((s, i + p - s), p)
    return sorted(((s, length, p) for (s, length), p in best.items()),
                  key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, found):
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_words(rnd):
    n, kinds = rnd.choice([0, 1, 5, 12, 30, 100, 300]), rnd.choice([1, 2, 2, 3, 5, 30])
    words = [rnd.randrange(kinds) for _ in range(n)]
    if n and rnd.random() < 0.5:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least, points", [(2, 500), (5, 1 << 20), (12, 37)])
def test_runs_equal_brute_force(monkeypatch, least, points):
    monkeypatch.setattr(periodic_runs, "_POINTS", points)
    rnd = random.Random(least)
    for _ in range(40):
        texts = [random_words(rnd) for _ in range(12)]
        counts = np.array([len(t) for t in texts])
        codes = np.array([c for t in texts for c in t], np.int32)
        got = list(zip(*(x.tolist() for x in runs(codes, counts, least))))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, least)]


def test_cover_and_extensions():
    pairs = {(a - b) % 13 for a in periodic_runs._COVER for b in periodic_runs._COVER}
    assert pairs == set(range(13))
    rnd = random.Random(4)
    for kinds in (1, 2, 40):
        body = [rnd.randrange(kinds) for _ in range(400)] * 2
        codes = np.array([-1, *body, -2], np.int32)
        i = np.array([rnd.randrange(1, 800) for _ in range(3000)])
        j = np.array([rnd.randrange(1, 800) for _ in range(3000)])
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i, j, Extensions(codes).forward(i, j)):
            n = 0
            while codes[a + n] == codes[b + n]:
                n += 1
            assert got == n


def planted(doc_id, text):
    """The contract's text of a document, as words."""
    words = split(text)
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, text)
    found = brute_runs(words, 12)
    best = (None,) * 4
    if found:
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    return (doc_id, len(found), *best, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(collapsed(words, found)))


def test_digests_of_awkward_rows(spark):
    rnd = random.Random(8)
    rows = cases.awkward()
    rows += [cases.row(100 + k, " ".join(f"w{w}" for w in random_words(rnd))) for k in range(200)]
    rows += [cases.row(400 + k, cases.prose(k, 150) + "\x0b\n \x1c " + "Ab aB " * k)
             for k in range(60)]
    got = digests(cases.frame(spark, rows)).collect()
    wanted = [expected(r[0], r[1]) for r in rows]
    assert sum(w[1] > 0 for w in wanted) > 50
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_spans_texts_and_other_columns(spark):
    line = word_runs(cases.frame(spark).where("doc_id = 19")).first()
    assert line.row_.words == "x" and line.row_["a.b"] == 0
    assert (line.n_words, [tuple(r) for r in line.runs], line.collapsed) == (
        400, [(0, 400, 1)], "x")
    line = word_runs(cases.frame(spark).where("doc_id = 1")).first()
    assert (line.n_words, line.runs, line.collapsed) == (0, [], "")


def test_very_long_texts(spark):
    body = cases.prose(9, 3000)
    rows = [cases.row(1, (body + " ") * 20), cases.row(2, "x " * 100_000)]
    got = {r.row_.doc_id: r for r in word_runs(cases.frame(spark, rows)).collect()}
    assert (0, 60_000, 3000) in [tuple(r) for r in got[1].runs]
    assert [tuple(r) for r in got[2].runs] == [(0, 100_000, 1)]


def test_empty_table_and_bad_parameter(spark):
    assert digests(cases.frame(spark, [])).count() == 0
    none = periodic_runs._described(pa.array([None, ""], pa.string()), 12)
    assert [x.to_pylist() for x in none] == [[0, 0], [[], []], ["", ""]]
    with pytest.raises(ValueError):
        word_runs(cases.frame(spark), least=1)
