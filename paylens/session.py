"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# The plans rely on adaptive execution for coalescing, broadcast conversion and
# for splitting skewed join partitions; everything else is left at its default.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort when every partition of one side turns out this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", app: str = "paylens", **conf) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_releasing: list[str] = []  # what the setting was, once for each block that is open


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, what a write has shuffled is deleted when it ends, not when the driver collects
    garbage. Blocks may be nested or run side by side; the last to end restores the setting."""
    with _lock:
        _releasing.append(_releasing[0] if _releasing else spark.conf.get(_CLEAN_UP))
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            given = _releasing.pop()
            if not _releasing:
                spark.conf.set(_CLEAN_UP, given)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="paylens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
