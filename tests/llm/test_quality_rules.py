import re

import cases

import __spark_entry__ as driver
from compare import connect, difference
from paylens.llm.quality_rules import keep_good, measured

SYMBOLS = re.compile(r"[#*$%&|<>]")


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i:i + 8]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1
               for i in places for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(found) < 20 or 100 * len(covered) > 30 * len(found)
    return (len(found), sum(map(len, found)), len(SYMBOLS.findall(text)),
            len(lines) - len(set(lines)), len(covered), failed)


def test_measures_of_awkward_rows(spark):
    extra = [cases.row(100, "a b c d e f g h " * 5 + cases.prose(9, 60)),
             cases.row(101, "l one\nl one\n\n\n \nl two\nl one"),
             cases.row(102, "a a a a a a a a a a " + "x#y|z<>&%$* " * 9)]
    rows = cases.awkward() + extra
    got = measured(cases.frame(spark, rows)).selectExpr(
        "row_.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute(r.text)
        assert not (r.base_failed and r.kept)


def test_fences_follow_the_group(spark):
    """A group full of symbols keeps them, a clean group does not."""
    def noisy(k):
        return " ".join(w + "#" for w in cases.prose(k, 40).split())

    rows = [cases.row(k, cases.prose(k, 40), "en", "clean") for k in range(150)]
    rows += [cases.row(1000 + k, noisy(k), "en", "markup") for k in range(150)]
    rows.append(cases.row(5000, noisy(1), "en", "clean"))
    kept = {r[0] for r in keep_good(cases.frame(spark, rows)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {5000}


def test_small_groups_use_merged_sketches(spark):
    rows = [cases.row(k, cases.prose(k, 40), "en", f"s{k}") for k in range(150)]
    rows.append(cases.row(900, "# ".join(cases.prose(3, 40).split()), "xx", None))
    kept = {r[0] for r in keep_good(cases.frame(spark, rows)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {900}


def test_columns_and_empty_table(spark):
    docs = cases.frame(spark, [])
    assert keep_good(docs).columns == docs.columns
    assert keep_good(docs).count() == 0


def test_equals_sql(spark):
    folder, name = "/root/testdata/sf0.01", "op10_quality_rules"
    con = connect(folder)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = driver.queries()[name](spark, folder)
    assert difference(found, con, driver.oracle_sql()[name]) is None
