"""Quoted line breaks in files that are read in pieces."""

import csv
import random

import pytest

from paylens.sources import quoted_csv
from paylens.sources.csv_folder import read_folder

STEM = "fraud_alert_history"


def cell(r):
    return "".join(r.choice(['a', 'b', '"', ',', '\n', '\r\n', ' ', 'é', '😀', '""', '\n\n'])
                   for _ in range(r.choice([0, 1, 3, 8, 40])))


def write(path, rows, header=("id", "text", "more"), end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, as 128 MB are to a large file."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(v)) for n, v in zip(names, (size, 0))]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def whole(spark, path):
    """What Spark's reader of whole files gives."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True) \
        .csv(str(path))


@pytest.mark.parametrize("size", [100, 1 << 20])
@pytest.mark.parametrize("end, quoting", [
    ("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_ALL)])
def test_equal_to_reading_whole_files(spark, tmp_path, small_splits, size, end, quoting):
    r, written = random.Random(size), []
    folder = tmp_path / f"{STEM}.csv"
    folder.mkdir()
    for k in range(2):
        rows = [(f"{k}-{n}", cell(r), cell(r)) for n in range(60)]
        rows.append((f"{k}-long", "x\n" * 500, "end"))  # one record over many splits
        rows += [(f"{k}-b{n}", cell(r), cell(r)) for n in range(30)]
        write(folder / f"{k}.csv", rows, end=end, quoting=quoting)
        written += rows
    small_splits(size)
    made = read_folder(spark, str(tmp_path))[STEM]
    lines = quoted_csv._lines(spark, [str(folder / "0.csv")])
    if size < 1000:
        assert lines.rdd.getNumPartitions() > 5
    got = sorted(map(tuple, made.collect()), key=str)
    assert sorted(tuple(c or "" for c in row) for row in got) == sorted(written)
    if end == "\n":  # the other reader turns quoted \r\n into \n if lines end with \r\n
        small_splits(1 << 27)
        assert got == sorted(map(tuple, whole(spark, folder).collect()), key=str)


def test_breaks_at_every_place_of_a_split(spark, tmp_path, small_splits):
    rows = [("1", 'a\n"b"\n\nc', "x"), ("2", "", '"'), ("3", "\n", "\n\n"), ("4", "plain", "y")]
    write(tmp_path / f"{STEM}.csv", rows)
    for size in range(8, 60, 4):
        small_splits(size)
        got = read_folder(spark, str(tmp_path))[STEM].collect()
        assert sorted((x.id, x.text or "", x.more or "") for x in got) == rows, size


def test_an_odd_number_of_quotes_stops(spark, tmp_path):
    (tmp_path / f"{STEM}.csv").write_text('id,text\n1,"a\n2,b\n')
    with pytest.raises(Exception, match="odd number of quotes"):
        read_folder(spark, str(tmp_path))[STEM].collect()


def test_a_row_with_other_columns_stops(spark, tmp_path):
    (tmp_path / f"{STEM}.csv").write_text('id,text\n1,"a\nb"\n2,b,c\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_folder(spark, str(tmp_path))[STEM].collect()


@pytest.mark.parametrize("stem", [STEM, "merchant_info"])
def test_parts_are_united_by_their_own_headers(spark, tmp_path, stem):
    folder = tmp_path / f"{stem}.csv"
    folder.mkdir()
    write(folder / "1.csv", [("1", "a,b", "x")])
    write(folder / "2.csv", [("y", "2", 'c"d')], header=("more", "id", "text"))
    write(folder / "3.csv", [])
    (folder / "4.csv").write_text("")
    got = read_folder(spark, str(tmp_path))[stem].collect()
    assert sorted((r.id, r.text, r.more) for r in got) == [("1", "a,b", "x"), ("2", 'c"d', "y")]
    write(folder / "5.csv", [("3", "a")], header=("id", "text"))
    with pytest.raises(ValueError, match="header"):
        read_folder(spark, str(tmp_path))


def test_files_without_rows_and_a_row_like_the_header(spark, tmp_path):
    path = tmp_path / f"{STEM}.csv"
    write(path, [])
    assert read_folder(spark, str(tmp_path))[STEM].count() == 0
    path.write_bytes(b"\xef\xbb\xbfid,text\n1,a\n")
    assert [tuple(r) for r in read_folder(spark, str(tmp_path))[STEM].collect()] == [("1", "a")]
    path.write_text("")
    with pytest.raises(ValueError, match="header"):
        read_folder(spark, str(tmp_path))
