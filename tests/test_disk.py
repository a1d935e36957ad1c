"""What loads hold on disk at once: packed text, no shuffle files of steps that have ended, slices."""

import csv
import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paylens.model import TABLES
from paylens.plans import intake
from paylens.session import released_shuffles
from paylens.sources import bucketed, files, store
from paylens.sources.cleaning import clean
from paylens.sources.csv_folder import as_tables, read_folder
from paylens.tables import Tables
from test_load import write_folder

NAME = "transaction_history"
SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def large(spark):
    """Every batch counts as large and every join shuffles."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def transactions(spark, ids):
    rows = [(i, "u", "c", datetime(2024, 1, 1) + timedelta(days=k), float(k), "send", None, "u9",
             "success", "d", "phone", "app", False, False, None) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, TABLES[NAME].schema)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager() \
        .getAllFiles()
    return {f for f in (found.apply(k).getName() for k in range(found.size()))
            if f.startswith("shuffle_") and f.endswith(".data")}


def test_loads_leave_no_shuffle_files(spark, tmp_path, large):
    before = shuffle_files(spark)
    store.load(spark, transactions(spark, [f"t{k}" for k in range(40)]), NAME, str(tmp_path), "a")
    store.load(spark, transactions(spark, [f"t{k}" for k in range(60)]), NAME, str(tmp_path), "b")
    made = shuffle_files(spark) - before
    assert len(made) <= 1, made  # counts of rows, as small as the number of tasks


def test_large_batches_are_written_in_slices(spark, tmp_path, large, monkeypatch):
    ids = [f"t{k}" for k in range(200)] + ["t5", None, None]
    parts, write = [], bucketed.write

    def watched(rows, *args):
        parts.append({r[0] for r in rows.select(F.pmod(F.hash("transaction_id"), F.lit(6)))
                      .distinct().collect()})
        write(rows, *args)

    monkeypatch.setattr(bucketed, "write", watched)
    first = store.load(spark, transactions(spark, ids[:120]), NAME, str(tmp_path), "a", buckets=6)
    assert len(parts) == 4 and sum(map(len, parts)) == len(set().union(*parts)) == 6
    assert first.rows_inserted == 120 and first.action == "fresh" and first.nulls["amount"] == 0
    second = store.load(spark, transactions(spark, ids), NAME, str(tmp_path), "b", buckets=6)
    assert (second.rows_incoming, second.rows_inserted, second.rows_skipped) == (203, 82, 121)
    third = store.load(spark, transactions(spark, ids), NAME, str(tmp_path), "c", buckets=6)
    assert (third.rows_before, third.rows_inserted, third.action) == (202, 0, "unchanged")
    stored = store.read_stored(spark, NAME, f"{tmp_path}/{NAME}")
    assert sorted(r[0] or "" for r in stored.select("transaction_id").collect()) == sorted(
        i or "" for i in [*ids[:200], None, None])
    assert stored.where("batch_id = 'b'").select("uploaded_at").distinct().count() == 1


def test_packed_files_are_read_like_plain_ones(spark, tmp_path):
    rows = [("1", "a,b", "x"), ("2", 'two\nlines and "quotes"', "é😀"), ("3", "", "y")]
    for stem in ("fraud_alert_history", "merchant_info"):
        for kind, opened in (("plain", open), ("packed", gzip.open)):
            place = tmp_path / kind / f"{stem}.csv"
            place.mkdir(parents=True)
            with opened(place / f"p.csv{'.gz' if kind == 'packed' else ''}", "wt", newline="",
                        encoding="utf-8") as f:
                out = csv.writer(f, lineterminator="\n")
                out.writerow(("id", "text", "more"))
                out.writerows(rows if stem.startswith("fraud") else rows[::2])
    assert files.first_line(
        spark, str(tmp_path / "packed/merchant_info.csv/p.csv.gz")) == "id,text,more"
    packed, plain = (read_folder(spark, str(tmp_path / kind)) for kind in ("packed", "plain"))
    for stem in plain:
        got = sorted(map(tuple, packed[stem].collect()))
        assert got == sorted(map(tuple, plain[stem].collect())) and len(got) > 1


def test_text_of_the_load_queries_is_packed(spark, tmp_path):
    write_folder(tmp_path / "in")
    raw = as_tables(read_folder(spark, str(tmp_path / "in")))
    t = Tables({name: clean(name, raw[name]) for name in TABLES})
    intake._as_csv(t, str(tmp_path / "out"))
    parts = [p for p in (tmp_path / "out").glob("*/part-*")]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    again = as_tables(read_folder(spark, str(tmp_path / "out")))
    for name in TABLES:
        assert sorted(map(str, again[name].collect())) == sorted(
            map(str, intake.raw_text(t, name).collect()))


def test_blocks_restore_the_setting(spark):
    before = spark.conf.get(SETTING)
    with released_shuffles(spark):
        with released_shuffles(spark):
            assert spark.conf.get(SETTING) == "true"
        assert spark.conf.get(SETTING) == "true"
    assert spark.conf.get(SETTING) == before
