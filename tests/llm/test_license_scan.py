import cases

from paylens.llm.license_scan import BASE, TEMPLATES, brute_words, scanned


def brute(text):
    found = brute_words(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(found))
              if found[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(found), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def scan(spark, rows):
    return scanned(cases.frame(spark, rows)).selectExpr(
        "row_.text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        "score").collect()


def test_base_phrases(spark):
    rows = cases.awkward() + [
        cases.row(100, "CC-BY cc by, cc\nby! ccby cc  bye"),
        cases.row(101, "all rights reserved. All Rights\tReserved all rights all rights reserved"),
        cases.row(102, "the GNU general PUBLIC license; General Public Licenses"),
        cases.row(103, "äcc by cc by"), cases.row(104, cases.prose(1, 9000) + " cc by"),
        cases.row(105, "by cc"), cases.row(106, "rights reserved all")]
    got = scan(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:6] == brute(r.text), r.text[:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_every_template_is_found_in_its_place(spark):
    rows = [cases.row(k, f"{cases.prose(k, 30)}\n{t.text.upper()}.\n{cases.prose(k + 50, 30)}")
            for k, t in enumerate(TEMPLATES)]
    by_text = {r.text: r for r in scan(spark, rows)}
    for r, t in zip(rows, TEMPLATES):
        got = by_text[r[1]]
        assert t.label in got.labels.split(",") and got.score == 1.0


def test_scattered_words_do_not_count(spark):
    words = " filler ".join("licensed under the apache license version".split())
    rows = [cases.row(1, words), cases.row(2, "apache mit the license license under"),
            cases.row(3, "the license of the mit"), cases.row(4, cases.prose(1, 50))]
    assert all(r.labels == "" and r.score == 0 for r in scan(spark, rows))


def test_empty_table(spark):
    assert scan(spark, []) == []


def test_many_notices_in_one_file(spark):
    """Rare words of one notice do not take the place of another's, whatever is frequent."""
    both = f"{TEMPLATES[2].text}. {TEMPLATES[0].text}."
    rows = [cases.row(1, " ; ".join(t.text for t in TEMPLATES)), cases.row(2, both)]
    rows += [cases.row(10 + k, "the apache license version 2 0 of a public license")
             for k in range(40)]
    got = {r.text: r for r in scan(spark, rows)}
    assert set(got[rows[0][1]].labels.split(",")) == {t.label for t in TEMPLATES}
    assert got[both].labels == "apache,mit" and got[both].score == 1.0
