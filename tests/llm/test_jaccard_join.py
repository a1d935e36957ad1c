import cases
import pytest

from paylens.llm import jaccard_join
from paylens.llm.jaccard_join import jaccard_components, keep_one_per_component


def brute(rows, n, percent):
    known = [(r[0], cases.shingle_set(r[1], n)) for r in rows if r[0] is not None]
    found = cases.components(known, percent)
    return sorted(((r[0], len(cases.shingle_set(r[1], n)),
                    None if r[0] is None else found[r[0]]) for r in rows), key=str)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_awkward_rows(spark, n, percent):
    got = jaccard_components(cases.frame(spark), n, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(cases.awkward(), n, percent)


def test_empty_table(spark):
    got = jaccard_components(cases.frame(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert got.count() == 0


def test_many_near_copies_of_one_text(spark):
    """Copies near the threshold, pairwise mostly not linked: every link must be found."""
    base = cases.prose(11, 150)
    rows = [cases.row(i, cases.edited(base, [(i * k * 7) % 150 for k in (1, 2, 3)]))
            for i in range(160)]
    got = jaccard_components(cases.frame(spark, rows), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)


def test_links_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """All pairs of 150 copies with an edit each are linked; a few links of each are enough."""
    base = cases.prose(12, 160)
    rows = [cases.row(i, cases.edited(base, [i + 5])) for i in range(150)]
    made, inner = [], jaccard_join.components

    def counted(links, scratch, label):
        made.append(links.count())
        return inner(links, scratch, label)

    monkeypatch.setattr(jaccard_join, "components", counted)
    # Leaders are left out, so that the blocks alone must find the links.
    monkeypatch.setattr(jaccard_join, "_near_size", lambda *_: jaccard_join.F.lit(False))
    got = jaccard_components(cases.frame(spark, rows), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)
    assert max(made) <= 150 * 16  # of 11,175 pairs; a class has other nearest ones in each list


def test_small_sets_at_the_threshold(spark):
    """All sizes up to 40 words, each with one to three edits."""
    rows = []
    for size in range(4, 40):
        text = cases.prose(size, size)
        rows += [cases.row(len(rows) + k, cases.edited(text, [size - 1 - x for x in range(k)]))
                 for k in range(4)]
    got = jaccard_components(cases.frame(spark, rows), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)


def test_one_row_of_each_component_stays(spark):
    docs = cases.frame(spark)
    kept = keep_one_per_component(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    found = cases.components([(r[0], cases.shingle_set(r[1], 5)) for r in cases.awkward()
                              if r[0] is not None], 80)
    expected = sorted([str(i) for i in found if found[i] == i] + ["None", "None"])
    assert ids == expected
