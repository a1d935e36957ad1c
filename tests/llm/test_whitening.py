import math
import random

import numpy as np
import pytest

from paylens.llm import whitening
from paylens.llm.whitening import Fit, by_component, whitened, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' AS x", "1 AS n", "2 AS dim")


def vectors(seed, count, dim=6, distinct=40):
    """Vectors with many copies: one of them is a third of all rows."""
    rnd = np.random.default_rng(seed)
    kinds = (rnd.normal(size=(distinct, dim)) * np.linspace(3, 0.3, dim)).astype(np.float32)
    which = np.where(rnd.random(count) < 1 / 3, 0, rnd.integers(0, distinct, count))
    return [(k, [float(c) for c in kinds[w]], 0) for k, w in enumerate(which)]


def textbook(rows, components=32):
    """x, n, deviations, eigenvalues and whitened rows of the valid vectors."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x], float)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, values / np.trace(c.T @ c / n), c @ axes / np.sqrt(values)


def check(spark, rows, got):
    n, deviation, explained, z = textbook(rows)
    lines = {}
    for r in got:
        lines.setdefault(r.vec_id, []).append(r)
    assert len(got) == z.size
    signs = None
    for (vec_id, _, _), d, expected in zip(rows, deviation, z):
        own = sorted(lines[vec_id], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, len(expected) + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, d)}
        values = np.array([r.whitened for r in own])
        if signs is None:
            signs = np.where(values * expected < 0, -1, 1)
        assert np.allclose(values * signs, expected, rtol=1e-7, atol=1e-9)
        assert np.allclose([r.explained for r in own], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("hot", [1000, 4, 1])
def test_equals_the_textbook(spark, monkeypatch, hot):
    """With no, some and all vectors taken for frequent ones."""
    monkeypatch.setattr(whitening, "_HOT", hot)
    rows = vectors(1, 400)
    check(spark, rows, by_component(table(spark, rows)).collect())


def test_odd_rows_are_left_out_and_repeated_ones_stay(spark):
    rows = vectors(2, 90)
    odd = [(500, None, 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (502, [float("nan")] * 6, 0),
           (503, [float("inf")] + [0.0] * 5, 0), (504, [], 0)]
    got = by_component(table(spark, rows + odd + [rows[0]] * 2 + [(None, rows[1][1], 1)])).collect()
    assert {r.vec_id for r in got} == {None, *range(90)}
    assert sum(r.vec_id == 0 for r in got) == 3 * 6
    assert {r.n for r in got} == {93}


def test_a_common_offset_costs_no_precision(spark):
    rows = [(k, [100_000 + c for c in v], 0) for k, v, _ in vectors(3, 200)]
    rows = [(k, [float(np.float32(c)) for c in v], 0) for k, v, _ in rows]
    check(spark, rows, by_component(table(spark, rows)).collect())


def test_weights_of_one_count_every_vector_once(spark):
    rows = vectors(4, 300)
    seen, once = set(), []
    for row in rows:
        if tuple(row[1]) not in seen:
            seen.add(tuple(row[1]))
            once.append(row)
    by_count = by_component(table(spark, once)).where("vec_id = 0").orderBy("component").collect()
    made = whitened(whole_vectors(table(spark, rows)), weights="one")
    made = made.where("row_.vec_id = 0").first()
    assert made.n == len(once)
    assert np.allclose(np.abs(made.whitened), [abs(r.whitened) for r in by_count])
    assert made.row_.label == 0 and made.row_.x == "k" and made.row_.dim == 2
    with pytest.raises(ValueError):
        whitened(whole_vectors(table(spark, rows)), weights="two")


def test_components_without_variance_are_null(spark):
    rows = [(k, [float(k % 5), 1.0, float(k % 3)], 0) for k in range(60)]
    got = whitened(whole_vectors(table(spark, rows))).collect()
    assert all(r.whitened[2] is None and r.whitened[1] is not None for r in got)
    assert got[0].identity_error < 1e-9 and got[0].explained[2] < 1e-12
    same = whitened(whole_vectors(table(spark, [(1, [2.0, 3.0], 0)] * 3))).collect()
    assert len(same) == 3
    assert {(r.n, r.deviation, r.identity_error) for r in same} == {(3, 0, None)}
    assert same[0].whitened == [None, None] and same[0].explained == [None, None]


def test_lengths_are_fitted_apart(spark):
    long, short = vectors(5, 80), [(1000 + k, v[:2], 0) for k, v, _ in vectors(6, 50)]
    got = by_component(table(spark, long + short)).collect()
    check(spark, long, [r for r in got if r.vec_id < 1000])
    check(spark, short, [r for r in got if r.vec_id >= 1000])


def test_empty_table(spark):
    made = by_component(table(spark, []))
    assert made.count() == 0
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                            "identity_error"]


def test_deviations_are_exact_or_an_error():
    rnd = random.Random(7)
    for size in (10, 10**7, 10**9):
        x = np.array([[rnd.randrange(size) for _ in range(3)] for _ in range(20)])
        n, s = 977, (x.sum(axis=0) * 3 + 5).tolist()
        fit = Fit(n, np.array([v // n for v in s]), np.array([v % n for v in s]),
                  np.zeros((3, 0)), [])
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist()]
        if max(exact) < 1 << 63:
            assert fit.deviations(x).tolist() == exact
        else:
            with pytest.raises(OverflowError):
                fit.deviations(x)


def test_components_too_large_for_whole_numbers_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        by_component(table(spark, [(1, [1e30, 1.0], 0), (2, [1.0, 2.0], 0)])).collect()
