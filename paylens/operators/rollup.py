"""Grouped aggregation of one table, or of a table through a lookup.

The measures of a query are named *facets*. Most can be combined from partial
results, which is what lets a fact table be reduced to one row per key before
it meets a large lookup table: the join then carries no hot key, however many
fact rows a single customer or merchant owns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import split_sum, tally
from ..tables import Tables
from .sizing import WIDE, fits_broadcast


@dataclass(frozen=True)
class Facet:
    """Aggregates over fact rows, by column name, and how partial results combine."""

    reads: tuple[str, ...]
    parts: dict[str, str]
    combine: str = "sum"
    moments: str | None = None  # the name of a standard deviation, see ``_spreads``


@dataclass(frozen=True)
class Key:
    """A grouping column; ``finish`` turns its compact form into the final one."""

    name: str
    reads: tuple[str, ...]
    value: str | Column
    finish: str | None = None

    def column(self) -> Column:
        made = F.expr(self.value) if isinstance(self.value, str) else self.value
        return made.alias(self.name)


@dataclass(frozen=True)
class Where:
    reads: tuple[str, ...]
    test: str


MONEY_DIGITS = 4
SCORE_DIGITS = 10


def _aggregate(name: str, column: str, sql: str, combine: str = "sum") -> Facet:
    return Facet((column,), {name: sql}, combine)


def _present(name: str, column: str) -> Facet:
    return _aggregate(name, column, f"count({column})")


def _tally(name: str, column: str, test: str = "{}") -> Facet:
    return _aggregate(name, column, tally(test.format(column)))


def _exact(name: str, column: str, digits: int) -> Facet:
    return Facet((column,), split_sum(column, name, digits))


def _spread(name: str, column: str) -> Facet:
    """The sample standard deviation, as count, mean and sum of squared deviations."""
    return Facet((column,), {
        f"{name}_n": f"count({column})", f"{name}_mean": f"avg({column})",
        f"{name}_m2": f"var_pop({column}) * count({column})"}, moments=name)


_ROWS = Facet((), {"rows": "count(1)"})

FACETS: dict[str, dict[str, Facet]] = {
    "transaction_history": {
        "rows": _ROWS,
        "ids": _present("ids", "transaction_id"),
        "value": _exact("value", "amount", MONEY_DIGITS),
        "priced": _present("priced", "amount"),
        "low": _aggregate("low", "amount", "min(amount)", "min"),
        "high": _aggregate("high", "amount", "max(amount)", "max"),
        "spread": _spread("spread", "amount"),
        "fraud": _tally("fraud", "fraud_flag"),
        "clean": _tally("clean", "fraud_flag", "NOT {}"),
        "reversed": _tally("reversed", "reversal_flag"),
        "failed": _tally("failed", "status", "{} = 'failed'"),
        "success": _tally("success", "status", "{} = 'success'"),
        "pending": _tally("pending", "status", "{} = 'pending'"),
        "latest": _aggregate("latest", "timestamp", "max(timestamp)", "max"),
    },
    "customer_feedback": {
        "rows": _ROWS,
        "ids": _present("ids", "feedback_id"),
        "score": _aggregate("score", "satisfaction_score", "sum(satisfaction_score)"),
        "scored": _present("scored", "satisfaction_score"),
        "resolved": _tally("resolved", "resolved"),
        "open": _tally("open", "resolved", "NOT {}"),
        "low": _tally("low", "satisfaction_score", "{} <= 2"),
        "high": _tally("high", "satisfaction_score", "{} >= 4"),
    },
    "device_info": {
        "rows": _ROWS,
        "ids": _present("ids", "device_id"),
        "rooted": _tally("rooted", "is_rooted"),
    },
    "customer_details": {
        "rows": _ROWS,
        "ages": _aggregate("ages", "age", "sum(age)"),
        "aged": _present("aged", "age"),
        "risk": _exact("risk", "risk_score", SCORE_DIGITS),
        "risked": _present("risked", "risk_score"),
        "business": _tally("business", "is_business_user"),
    },
    "account_details": {"rows": _ROWS},
    "merchant": {"rows": _ROWS},
    "fraud_alert": {
        "rows": _ROWS,
        "resolved": _tally("resolved", "resolved"),
        "open": _tally("open", "resolved", "NOT {}"),
    },
}

def as_keys(keys: Iterable[Key | str]) -> list[Key]:
    made = []
    for key in keys:
        if isinstance(key, str):
            key = Key(key, (key,), key)
        made.append(key)
    return made


def _facets(table: str, names: str) -> list[Facet]:
    return [FACETS[table][name] for name in names.split()]


def _needed(facets: Sequence[Facet], keys: Sequence[Key], where: Where | None, *more: str) -> list:
    wanted = [*more]
    for source in (*facets, *keys, *((where,) if where else ())):
        wanted.extend(source.reads)
    return list(dict.fromkeys(wanted))


def _measures(facets: Sequence[Facet]) -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for f in facets for name, sql in f.parts.items()]


def _combined(facets: Sequence[Facet]) -> list[Column]:
    """Combined parts; of moments only what the first of two steps needs."""
    made = []
    for f in facets:
        if f.moments:
            count, mean = f"{f.moments}_n", f"{f.moments}_mean"
            made += [F.expr(f"sum({count}) AS {count}"),
                     F.expr(f"sum({count} * {mean}) / nullif(sum({count}), 0) AS {mean}")]
        else:
            made += [F.expr(f"{f.combine}({name}) AS {name}") for name in f.parts]
    return made


def _deviation(name: str) -> str:
    return f"CASE WHEN {name}_n > 1 THEN sqrt({name}_m2 / ({name}_n - 1)) END"


def _spreads(df: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """Standard deviations from count, mean and squared deviations of whole groups."""
    for f in facets:
        if f.moments:
            df = df.withColumn(f.moments, F.expr(_deviation(f.moments))).drop(*f.parts)
    return df


def _merged(
    parts: DataFrame, keys: Sequence[Key], facets: Sequence[Facet], more: Sequence[Column] = (),
) -> DataFrame:
    """Groups of parts.

    Squared deviations are taken from the mean of the whole group, as the parallel formula
    does, so that no large numbers cancel: the groups come first, and their means, a row per
    group, meet the parts again.
    """
    groups = _grouped(parts, keys, [*_combined(facets), *more])
    spread = [f.moments for f in facets if f.moments]
    if not spread:
        return groups
    means = groups.select(*[F.col(k.name).alias(f"g_{k.name}") for k in keys],
                          *[F.col(f"{name}_mean").alias(f"whole_{name}") for name in spread])
    same = [f"{k.name} <=> g_{k.name}" for k in keys] or ["true"]
    apart = parts.join(means, F.expr(" AND ".join(same)))
    squares = _grouped(apart, keys, [F.expr(
        f"sum({name}_m2 + {name}_n * pow({name}_mean - whole_{name}, 2)) AS {name}_m2")
        for name in spread])
    squares = squares.select(*[F.col(k.name).alias(f"g_{k.name}") for k in keys],
                             *[f"{name}_m2" for name in spread])
    joined = groups.join(squares, F.expr(" AND ".join(same)))
    return _spreads(joined.drop(*[f"g_{k.name}" for k in keys]), facets)


def _finish(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    late = {k.name: F.expr(k.finish) for k in keys if k.finish}
    return df.withColumns(late) if late else df


def _grouped(df: DataFrame, keys: Sequence[Key], measures: list[Column]) -> DataFrame:
    return df.groupBy(*[k.column() for k in keys]).agg(*measures)


def scan(tables: Tables, table: str, columns: Sequence[str], where: Where | None) -> DataFrame:
    if not columns:
        columns = [tables.columns(table)[0]]
    df = tables.scan(table, *columns)
    return df.where(where.test) if where else df


def rollup(
    tables: Tables, table: str, keys: Iterable[Key | str], facets: str,
    where: Where | None = None,
) -> DataFrame:
    """One scan and one shuffle of partial results; global when there are no keys."""
    keys, measures = as_keys(keys), _facets(table, facets)
    rows = scan(tables, table, _needed(measures, keys, where), where)
    return _finish(_spreads(_grouped(rows, keys, _measures(measures)), measures), keys)


def combined(df: DataFrame, table: str, keys: Iterable[str], facets: str) -> DataFrame:
    """Facets of the groups of ``keys``, from those of parts of the table."""
    return _merged(df, as_keys(keys), _facets(table, facets))


def lookup_rows(
    tables: Tables, table: str, on: str, keys: Sequence[Key], where: Where | None = None
) -> DataFrame:
    """The join column and the finished grouping columns of a lookup table."""
    rows = scan(tables, table, _needed((), keys, where, on), where)
    columns = [k.column() for k in keys if k.name != on]
    return rows.select(on, *columns)


def rollup_through(
    tables: Tables, fact: str, lookup: str, on: str, keys: Iterable[Key | str], facets: str,
    *, fact_keys: Iterable[Key | str] = (), where: Where | None = None,
    lookup_where: Where | None = None, distinct_as: str | None = None,
    reduce_first: bool = True,
) -> DataFrame:
    """Aggregate ``fact`` by columns of ``lookup`` (inner join on ``on``).

    * a small lookup (size checked) is broadcast: the fact table is not shuffled;
    * otherwise the fact table is first reduced to one row per ``on``;
    * ``reduce_first=False`` uses a plain join, whose hot keys adaptive execution splits on
      the fact side.

    ``distinct_as`` adds the number of different ``on`` values per group.
    """
    keys, fact_keys = as_keys(keys), as_keys(fact_keys)
    measures = _facets(fact, facets)
    rows = scan(tables, fact, _needed(measures, fact_keys, where, on), where)
    parents = lookup_rows(tables, lookup, on, keys, lookup_where)
    by_lookup = as_keys(k.name for k in keys)
    everything = [*keys, *fact_keys]

    times = 1 if reduce_first else WIDE  # else every row of the fact table would move
    direct = (all(k.name != on for k in keys) and distinct_as is None
              and fits_broadcast(parents, times))
    if direct:
        df = rows.join(F.broadcast(parents), on)
        df = _spreads(_grouped(df, [*by_lookup, *fact_keys], _measures(measures)), measures)
    elif not reduce_first:
        df = rows.join(parents, on)
        df = _spreads(_grouped(df, [*by_lookup, *fact_keys], _measures(measures)), measures)
    else:
        per_key = _grouped(rows, [*as_keys([on]), *fact_keys], _measures(measures))
        more = [F.count_distinct(on).alias(distinct_as)] if distinct_as else []
        by_fact = as_keys(k.name for k in fact_keys)
        df = _merged(per_key.join(parents, on), [*by_lookup, *by_fact], measures, more)
    return _finish(df, everything)


def rollup_around(
    tables: Tables, lookup: str, fact: str, on: str, keys: Iterable[Key | str], facets: str,
    *, count_as: str | None = None, weighted: dict[str, str] | None = None,
) -> DataFrame:
    """Aggregate ``lookup`` LEFT JOIN ``fact`` by columns of ``lookup``.

    A parent without fact rows counts as one row, as a left join makes it. The
    fact table is reduced to one row per parent first. ``weighted`` maps a
    lookup column to the name of its average over the joined rows.
    """
    keys, measures = as_keys(keys), _facets(fact, facets)
    if any(f.moments for f in measures):
        raise ValueError("no standard deviations of left-joined rows")
    rows = scan(tables, fact, _needed(measures, (), None, on), None)
    per_key = _grouped(rows, as_keys([on]), _measures(measures))
    carried = as_keys((weighted or {}).keys())
    parents = lookup_rows(tables, lookup, on, [*keys, *(c for c in carried if c not in keys)])

    zero = {
        name: F.expr(f"coalesce({name}, {1 if name == 'rows' else 0})")
        for f in measures if f.combine == "sum" for name in f.parts
        if not name.startswith("value")
    }
    joined = parents.join(per_key, on, "left").withColumns(zero)
    merged = _combined(measures)
    if count_as:
        merged.append(F.count_distinct(on).alias(count_as))
    for column, name in (weighted or {}).items():
        weight = f"sum(CASE WHEN {column} IS NOT NULL THEN rows END)"
        merged.append(F.expr(f"sum({column} * rows) / {weight} AS {name}"))
    df = _grouped(joined, as_keys(k.name for k in keys), merged)
    return _finish(df, keys)
