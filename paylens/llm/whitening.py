"""Whitening of vectors by the covariance of their different values and multiplicities.

Identical vectors are grouped first. Sums, centred products and the whitened vectors are
then made once per different vector, weighted by the number of its copies (or by one), and
joined back to the rows. Sums are exact whole numbers; the centre is subtracted in whole
numbers before anything is multiplied, so a large common offset costs no precision. Tasks
hand on dim + dim^2 numbers each, which Spark adds up; the driver receives one such set per
vector length, never anything that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

_HOT = 1000  # a vector with more than one in so many rows is joined by broadcast
_LARGEST = float(1 << 52)  # whole numbers up to it are exact as doubles
_ROWS = 4096  # vectors that are worked on at once


@dataclass(frozen=True)
class Fit:
    """What the vectors of one length have in common."""

    n: int
    floor: np.ndarray  # whole part of the mean, as whole numbers
    rest: np.ndarray  # n times what the mean has beyond it, in 0 .. n - 1
    projection: np.ndarray  # eigenvectors over the root of their eigenvalues; NaN without variance
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of every row, exact; an error beyond 64 bits."""
        y = x - self.floor
        largest = (abs(y).max(initial=0).item() + 1) * self.n
        if largest**2 * x.shape[1] < 1 << 63:
            return ((y * self.n - self.rest) ** 2).sum(axis=1)
        sums = ((y.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        if sums.max() >= 1 << 63:
            raise OverflowError("a deviation does not fit into 64 bits")
        return sums.astype(np.int64)


def whole_vectors(table: DataFrame, vector: str = "embedding", scale: int = 64,
                  offset: int = 1_000_000) -> DataFrame:
    """Rows of ``table`` with ``x``: floor(scale c) + offset of every component c, as a double.

    Rows whose vector is null, or holds a null or non-finite component, are left out.
    Components beyond 2^52 / scale are an error. Columns are nested in ``row_``.
    """
    c = f"{scale}D * CAST(c AS DOUBLE)"
    infinite = "abs(CAST(c AS DOUBLE)) = double('inf')"
    odd = f"exists(`{vector}`, c -> c IS NULL OR isnan(c) OR {infinite})"
    large = "CAST(raise_error('component too large to be a whole number') AS BIGINT)"
    # Spark may compute this before it leaves out a row, so odd components are no error.
    x = (f"CASE WHEN abs({c}) < {_LARGEST}D THEN floor({c}) + {offset}L"
         f" WHEN abs({c}) < double('inf') THEN {large} END")
    others = [F.col(f"`{name}`") for name in table.columns if name != vector]
    return table.where(f"`{vector}` IS NOT NULL AND NOT {odd}").select(
        F.struct(*others).alias("row_"), F.expr(f"transform(`{vector}`, c -> {x})").alias("x"))


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of every list length in a batch, some thousand rows at a time."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy()
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        for first in range(0, len(rows), _ROWS):
            at = rows[first:first + _ROWS]
            flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield int(dim), at, flat.reshape(-1, dim)


def _exact_sums(distinct: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """By vector length: rows, weight, and the weighted sum of every component."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            copies, weights = (batch.column(c).to_numpy() for c in ("copies", "weight"))
            for dim, at, x in _by_length(batch, "x"):
                w = weights[at]
                n, total = int(w.sum()), [int(copies[at].sum())]
                if abs(x).max().item() * n >= 1 << 63:
                    x, w = x.astype(object), w.astype(object)
                sums = held.setdefault(dim, [0, 0] + [0] * dim)
                for k, value in enumerate([*total, n, *(w @ x).tolist()]):
                    sums[k] += value
        lines = [(d, k, str(v)) for d, sums in held.items() for k, v in enumerate(sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _, _ in lines], pa.int32()),
             pa.array([k for _, k, _ in lines], pa.int32()),
             pa.array([v for _, _, v in lines], pa.string())], names=["dim", "k", "v"])

    parts = distinct.select("x", "copies", "weight").mapInArrow(run, "dim int, k int, v string")
    sums = parts.groupBy("dim", "k").agg(F.sum(F.expr("CAST(v AS DECIMAL(38, 0))")).alias("v"))
    found: dict[int, dict[int, int]] = {}
    for line in sums.collect():  # dim + 2 lines for each vector length
        found.setdefault(line.dim, {})[line.k] = int(line.v)
    return {dim: (v[0], v[1], [v[k + 2] for k in range(dim)]) for dim, v in found.items()}


def _products(
    distinct: DataFrame, column: str, centred: Callable[[int, np.ndarray], np.ndarray],
) -> dict[int, np.ndarray]:
    """By vector length: the weighted sum of the products of all pairs of centred components."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            weights, lengths = batch.column("weight").to_numpy(), batch.column("dim").to_numpy()
            for _, at, x in _by_length(batch, column):
                for dim in np.unique(lengths[at]):
                    own = lengths[at] == dim
                    c = centred(int(dim), x[own])
                    made = (c * weights[at][own, None]).T @ c
                    held[int(dim)] = held.get(int(dim), 0) + made
        for dim, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()),
                 pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())],
                names=["dim", "i", "j", "v"])

    parts = distinct.select(column, F.size("x").alias("dim"), "weight") \
        .mapInArrow(run, "dim int, i int, j int, v double")
    found: dict[int, np.ndarray] = {}
    for line in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")) \
            .groupBy("dim").agg(F.collect_list(F.struct("i", "j", "v")).alias("cells")).collect():
        size = max(c.j for c in line.cells) + 1  # dim^2 / 2 cells, whatever the rows
        m = np.zeros((size, size))
        for c in line.cells:
            m[c.i, c.j] = m[c.j, c.i] = c.v
        found[line.dim] = m
    return found


def _centred_by(sums: dict[int, tuple[int, int, list[int]]]) -> dict[int, Fit]:
    """The exact centres, without components yet."""
    found = {}
    for dim, (_, n, s) in sums.items():
        floor = [v // n for v in s]
        rest = [v - n * f for v, f in zip(s, floor)]
        found[dim] = Fit(n, np.array(floor, np.int64), np.array(rest, np.int64),
                         np.zeros((dim, 0)), [])
    return found


def fitted(distinct: DataFrame, components: int) -> tuple[dict[int, Fit], int]:
    """Centre, eigenvectors and eigenvalues by vector length, and the number of rows.

    distinct: (x, copies, weight). An eigenvalue that is not told from zero in double
    precision has no direction to whiten: its column of the projection is NaN.
    """
    sums = _exact_sums(distinct)
    centres = _centred_by(sums)
    made = {}
    for dim, total in _products(distinct, "x", lambda dim, x: centres[dim].centred(x)).items():
        centre = centres[dim]
        covariance = total / centre.n
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(covariance))
        positive = values > trace * dim * np.finfo(float).eps
        roots = np.sqrt(np.where(positive, values, np.nan))
        explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]
        made[dim] = Fit(centre.n, centre.floor, centre.rest, vectors / roots, explained)
    return made, sum(rows for rows, _, _ in sums.values())


def _whitened_once(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Every different vector with ``deviation`` and ``whitened``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch, "x"):
                fit = fits[dim]
                z = fit.centred(x) @ fit.projection
                flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * z.shape[1]), flat)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(fit.deviations(x), pa.int64()), lists],
                    names=[*part.schema.names, "deviation", "whitened"])

    made = T.StructType([*distinct.schema, T.StructField("deviation", T.LongType()),
                         T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return distinct.mapInArrow(run, made)


def _identity_errors(once: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """By vector length: the largest entry of the whitened covariance minus the identity.

    Only of components with variance; None where there is none.
    """
    sums = once.select(F.size("x").alias("dim"), "weight", F.posexplode("whitened")) \
        .groupBy("dim", "pos").agg(F.sum(F.col("col") * F.col("weight")).alias("v"))
    means = {dim: np.zeros(fit.projection.shape[1]) for dim, fit in fits.items()}
    for line in sums.collect():  # one line per length and component
        means[line.dim][line.pos] = np.nan if line.v is None else line.v / fits[line.dim].n
    found = _products(once, "whitened", lambda dim, z: z - means[dim])
    errors = {}
    for dim, m in found.items():
        live = ~np.isnan(fits[dim].projection).any(axis=0)
        held = m[np.ix_(live, live)] / fits[dim].n
        errors[dim] = float(abs(held - np.eye(len(held))).max()) if live.any() else None
    return errors


def whitened(vectors: DataFrame, components: int = 32, weights: str = "counts") -> DataFrame:
    """Rows of ``vectors`` (x array<bigint>, ...) projected on their principal components.

    Result: row_ (struct, as given), n, deviation, whitened, explained, identity_error.
    n: total weight, the divisor of every covariance. deviation: sum over components of
    (n x - S)^2, S the weighted sum. whitened[k]: the centred vector on the k-th unit
    eigenvector over the root of its eigenvalue, by falling eigenvalue, at most
    ``components``; null where the eigenvalue is zero. explained[k]: the eigenvalue's share
    of the trace, null if the trace is zero. identity_error: see ``_identity_errors``.

    ``weights``: "counts" fits on all rows, "one" on every different vector once. Vectors of
    different lengths are fitted apart; null and empty ones are left out. Repeated rows and
    ids and null ids stay, and an empty table gives an empty result.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights are 'counts' or 'one', not {weights!r}")
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = vectors.where("x IS NOT NULL AND size(x) > 0").select("row_", "x")
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = scratch.save(
        rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", weight),
        "distinct")
    fits, total = fitted(distinct, components)
    once = scratch.save(_whitened_once(distinct, fits), "whitened")
    scratch.drop("distinct")
    errors = _identity_errors(once, fits)
    shared = vectors.sparkSession.createDataFrame(
        [(dim, fit.n, fit.explained, errors.get(dim)) for dim, fit in fits.items()],
        "dim int, n long, explained array<double>, identity_error double")
    return _joined_back(rows, once, total).join(
        F.broadcast(shared), F.size("x") == F.col("dim")).select(
            "row_", "n", "deviation", "whitened", "explained", "identity_error")


def _joined_back(rows: DataFrame, once: DataFrame, total: int) -> DataFrame:
    """Every row with what was made for its vector.

    The vectors of more than one row in a thousand, fewer than a thousand, are broadcast;
    so no vector's rows gather in one task.
    """
    made = once.select("x", "deviation", "whitened")
    is_hot = F.col("copies") * F.lit(_HOT) > F.lit(total)
    hot, cold = made.where(is_hot), made.where(~is_hot)
    often = rows.join(F.broadcast(hot), "x")
    seldom = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(cold, "x")
    return often.unionByName(seldom)


def by_component(table: DataFrame, components: int = 32) -> DataFrame:
    """A line per row and component of a table (vec_id, embedding); see ``whitened``.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    made = whitened(whole_vectors(table.select("vec_id", "embedding")), components)
    return made.select(
        "row_.vec_id", F.posexplode("whitened").alias("place", "whitened"), "n", "deviation",
        "explained", "identity_error",
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.expr("explained[place]").alias("explained"), "identity_error")
