"""Which batches make up a stored table: numbered versions, each a small file.

A load writes its folders under names of its own and then adds the next version, a file
that must not exist yet. That one step makes the load visible. Nothing is renamed and
nothing that a version names is changed, so readers and failed loads never meet half a
batch, on object stores too. A version whose text is cut off does not count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from . import files


class ConcurrentLoad(RuntimeError):
    """Another load has changed the table since this one looked at it."""


@dataclass(frozen=True)
class Batch:
    name: str
    folder: str  # below the table's data, keys and zones
    rows: int
    null_keys: int = 0
    low: str | None = None  # smallest and largest value of the table's order column
    high: str | None = None


@dataclass(frozen=True)
class Version:
    number: int = 0
    batches: tuple[Batch, ...] = ()
    buckets: int = 0  # of the key index, the same for all batches
    base: int = field(default=0, compare=False)

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.batches)


def _folder(path: str) -> str:
    return f"{path}/versions"


def _file(path: str, number: int) -> str:
    return f"{_folder(path)}/{number:012d}.json"


def _sum(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all version files, whole or not, the newest first."""
    if not files.exists(spark, _folder(path)):
        return []
    names = (n.removesuffix(".json") for n in files.children(spark, _folder(path))
             if n.endswith(".json"))
    return sorted((int(n) for n in names if n.isdecimal()), reverse=True)


def read(spark: SparkSession, path: str, number: int) -> Version | None:
    """A version; None if its file is not whole."""
    body, _, check = files.read(spark, _file(path, number)).partition("\n")
    if check.strip() != _sum(body):
        return None
    held = json.loads(body)
    return Version(number, tuple(Batch(**b) for b in held["batches"]), held["buckets"],
                   held["base"])


def current(spark: SparkSession, path: str) -> Version:
    """The newest whole version; one without batches if there is none."""
    for number in numbers(spark, path):
        version = read(spark, path, number)
        if version:
            return version
    return Version()


def commit(
    spark: SparkSession, path: str, base: Version, batches: Iterable[Batch], buckets: int,
) -> Version:
    """Add the version that follows ``base``; ConcurrentLoad if it is not the newest any more."""
    taken = numbers(spark, path)
    version = Version(max(taken, default=0) + 1, tuple(batches), buckets, base.number)
    if current(spark, path) != base:
        raise ConcurrentLoad(f"{path}: changed since version {base.number}")
    body = json.dumps({"base": base.number, "buckets": buckets,
                       "batches": [asdict(b) for b in version.batches]})
    file = _file(path, version.number)
    try:
        files.create(spark, file, f"{body}\n{_sum(body)}\n")
    except FileExistsError:
        raise ConcurrentLoad(f"{path}: version {version.number} is being written") from None
    # A version that was being written while this one was made may be whole by now.
    between = [n for n in numbers(spark, path) if base.number < n < version.number]
    if any(read(spark, path, n) for n in between):
        files.remove(spark, file)
        raise ConcurrentLoad(f"{path}: changed since version {base.number}")
    return version
