"""References, primary keys and row rules of several tables, checked in one shuffle.

A row becomes one line per thing to be counted: its key for those who refer to it, each of
its references, and the rules it breaks as a bit mask. Lines are (tag, key, slot): the tag
names the key that is referred to, slot 0 counts rows that have it and slot k those of the
k-th reference to it. They are combined per task and grouped by (tag, key) once; what is
missing, repeated or broken follows from the groups, one by one. Lines of one column come
from a scan of that column alone: no byte is read twice for keys, and no row is copied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Tables
from .joins import rows_with_key_in
from .sizing import fits_broadcast


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` whose ``column`` should be a ``key`` of ``parent``."""

    child: str
    column: str
    parent: str
    key: str
    skip_null: bool = True  # a NULL refers to nothing; otherwise it counts as lost


def audit(
    tables: Tables, links: Sequence[Link] = (), keys: Mapping[str, str] | None = None,
    rules: Mapping[str, Sequence[str]] | None = None,
    reads: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row of counts.

    For the i-th link: lost_i, child rows without a parent. For every table of ``keys``
    (its key column): repeated_<table>, rows beyond the first of each key, and nulls_<table>,
    rows with a NULL key. For every table of ``rules`` (SQL of a bad row, at most 62 each):
    rows_<table> and bad_<table>_<i>; ``reads`` names their columns, if not all are needed.
    """
    keys, rules, reads = dict(keys or {}), dict(rules or {}), dict(reads or {})
    tags: dict[tuple[str, ...], int] = {}

    def tag(*what: str) -> int:
        return tags.setdefault(what, len(tags))

    lines: list[tuple[str, tuple[int, str, int], list[str]]] = []

    def emit(table: str, tag_: int, column: str, slot: int) -> None:
        line = (table, (tag_, f"CAST(`{column}` AS STRING)", slot), [column])
        if line not in lines:
            lines.append(line)

    slots = []
    for link in links:
        place = tag(link.parent, link.key)
        slots.append((place, 1 + sum(place == p for p, _ in slots)))
        emit(link.child, place, link.column, slots[-1][1])
    for parent in dict.fromkeys((link.parent, link.key) for link in links):
        emit(parent[0], tag(*parent), parent[1], 0)
    for table, key in keys.items():
        emit(table, tag(table, key), key, 0)
    for table, tests in rules.items():
        if len(tests) > 62:
            raise ValueError(f"{table}: more than 62 rules")
        bits = [f"CASE WHEN {test} THEN {1 << i}L ELSE 0L END" for i, test in enumerate(tests)]
        mask = f"CAST({' + '.join(bits) or '0L'} AS STRING)"
        needed = reads.get(table) or tables.columns(table)
        lines.append((table, (tag("rules", table), mask, 0), list(needed if tests else needed[:1])))

    parts = [_lines(tables, *line, links, keys) for line in lines]
    widest = max((slot for _, slot in slots), default=0)
    grouped = reduce(DataFrame.unionAll, parts).groupBy("tag", "key").agg(*[
        F.expr(f"sum(CASE WHEN slot = {k} THEN 1L ELSE 0L END) AS s{k}")
        for k in range(widest + 1)])

    def total(name: str, tag_: int, value: str, test: str = "true") -> str:
        return (f"coalesce(sum(CASE WHEN tag = {tag_} THEN CASE WHEN {test} THEN {value}"
                f" ELSE 0L END ELSE 0L END), 0L) AS {name}")

    found = []
    for i, (link, (place, slot)) in enumerate(zip(links, slots)):
        lost = "key IS NOT NULL AND s0 = 0" + ("" if link.skip_null else " OR key IS NULL")
        found.append(total(f"lost_{i}", place, f"s{slot}", lost))
    for table, key in keys.items():
        found += [total(f"repeated_{table}", tag(table, key), "s0 - 1", "s0 > 1"),
                  total(f"nulls_{table}", tag(table, key), "s0", "key IS NULL")]
    for table, tests in rules.items():
        place = tag("rules", table)
        found.append(total(f"rows_{table}", place, "s0"))
        found += [total(f"bad_{table}_{i}", place, "s0",
                        f"(try_cast(key AS BIGINT) & {1 << i}L) <> 0") for i in range(len(tests))]
    return grouped.agg(*[F.expr(sql) for sql in found])


def _lines(
    tables: Tables, table: str, line: tuple[int, str, int], columns: Sequence[str],
    links: Sequence[Link], keys: Mapping[str, str],
) -> DataFrame:
    tag, key, slot = line
    df = tables.scan(table, *columns)
    referring = [k for k in links if slot == 0 and [k.key] == list(columns) and k.parent == table]
    if len(referring) == 1 and keys.get(table) != columns[0]:
        child = tables.scan(referring[0].child, referring[0].column)
        # Of a large parent only the few keys that are asked for; other counts need them all.
        if fits_broadcast(child) and not fits_broadcast(df):
            wanted = child.select(F.col(referring[0].column).alias(columns[0])).distinct()
            df = rows_with_key_in(df, wanted, columns[0])
    return df.selectExpr(f"{tag} AS tag", f"{key} AS key", f"{slot} AS slot")
