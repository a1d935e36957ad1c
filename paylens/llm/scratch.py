"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of its own for one operator run.

    ``save`` cuts the lineage with a written table, so a lost executor costs the
    tasks of one step and never the steps before it. Tables that nothing reads
    any more are dropped; what the returned DataFrame reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        # What the step shuffled is deleted with its end, not when the driver collects garbage.
        conf, given = self.spark.conf, self.spark.conf.get(_CLEAN_UP)
        conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEAN_UP, given)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)
