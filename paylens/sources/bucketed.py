"""Files in hash buckets, so that joins and comparisons by one column move nothing.

Spark knows about buckets through a table of its catalog. One is declared over the files
for as long as it takes to write them, or to build a DataFrame that reads them, and is
dropped without touching the files. All loads of a table have the same number of buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD, MONTH = "load_", "month_"
CODEC = "zstd"  # some six tenths of what the default takes, in no more time
_FILES_A_YEAR = 96  # of one load, as long as a stretch is not longer than all of its rows
_STRETCHES = (1, 2, 3, 4, 6, 12)  # months; beyond, whole years


def default_buckets(spark: SparkSession) -> int:
    """As many as the session's shuffles have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stretch_months(buckets: int) -> int:
    """How many months the files of a bucket cover each.

    Files per load are buckets times stretches: the more buckets, the longer the stretches.
    """
    wanted = -(-12 * buckets // _FILES_A_YEAR)
    return next((n for n in _STRETCHES if n >= wanted), 12 * -(-wanted // 12))


def _first_month(order: str, months: int) -> Column:
    """The stretch a date or moment is in, by its first month as yyyymm."""
    month = F.year(order) * 12 + F.month(order) - 1
    first = month - F.pmod(month, F.lit(months))
    return (F.floor(first / 12) * 100 + F.pmod(first, F.lit(12)) + 1).cast("int")


@contextmanager
def _declared(
    spark: SparkSession, schema: T.StructType, by: str, buckets: int, path: str,
    more: str = "", sort: str = "",
) -> Iterator[str]:
    name = f"spark_catalog.default.paylens_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {more} CLUSTERED BY (`{by}`) {sort}"
              f" INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write(
    rows: DataFrame, by: str, path: str, load: str, buckets: int, order: str | None = None,
    written: Observation | None = None,
) -> None:
    """Writes a load to ``path``/``load``, and marks its rows with the load.

    With an ``order`` column, a date or moment, files hold a stretch of months each (see
    ``stretch_months``) and are sorted by it. Partitions are balanced: a key with most of the
    rows is written by many tasks.
    """
    rows = rows.withColumn(LOAD, F.lit(load))
    more, sort = f"OPTIONS (compression '{CODEC}')", ""
    if order:
        rows = rows.withColumn(MONTH, _first_month(order, stretch_months(buckets)))
        more, sort = f"{more} PARTITIONED BY ({MONTH})", f"SORTED BY (`{order}`)"
    schema = rows.schema
    rows = rows.hint("rebalance", buckets, by)
    if written is not None:
        rows = rows.observe(written, F.count(F.lit(1)).alias("n"))
    with _declared(rows.sparkSession, schema, by, buckets, f"{path}/{load}", more, sort) as table:
        rows.write.insertInto(table)


def read(
    spark: SparkSession, schema: T.StructType, by: str, path: str, loads: Iterable[str],
    buckets: int,
) -> DataFrame:
    """The rows of the given loads, which Spark takes as divided by ``by``."""
    held = T.StructType([*schema, T.StructField(LOAD, T.StringType())])
    with _declared(spark, held, by, buckets, path, "OPTIONS (recursiveFileLookup 'true')") as table:
        return spark.table(table).where(F.col(LOAD).isin(list(loads))).select(*schema.names)
