"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned into whole numbers. Rows are put in the order of (nearest
centre, vec_id) and cut into blocks of that order; a block keeps the largest and
smallest value of every dimension, and its rows as a forward index. For a query the
sum over dimensions of its largest possible products bounds every score in the
block. Each query first scores the two blocks with the highest bounds. Its k-th
score then rules out all blocks whose bound is below (or equal, with only larger
ids); the others are scored through their forward indexes.

Queries go in batches, and a batch meets the summaries of all blocks group by
group, so neither side is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_BLOCK = 512  # rows of a block
_BATCH = 256  # queries of a batch
_GROUP = 1024  # block summaries that a batch meets at once
_CENTRES = 64
_SAMPLE = 4096  # rows that the centres are fitted on
_SEEDS = 2  # blocks scored before any is ruled out


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v, dim): floor(256 x) of every component; invalid vectors left out."""
    odd = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('inf'))"
    return table.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT {odd}").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.expr("transform(embedding, x -> CAST(floor(256D * CAST(x AS DOUBLE)) AS BIGINT))")
        .alias("v"),
        F.size("embedding").alias("dim"),
    ).where("dim > 0")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products; by floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centres per dimension count, fitted on a bounded sample; they only order the rows."""
    share = min(1.0, _SAMPLE / max(1, vectors.count()))
    held = vectors.where(F.expr(f"pmod(xxhash64(vec_id), 1000003) < {share} * 1000003D")) \
        .select("dim", "v").toArrow()
    dims = held.column("dim").to_numpy()
    found = {}
    for dim in np.unique(dims):
        rows = held.filter(pa.array(dims == dim)).column("v").combine_chunks()
        points = _matrix(rows, int(dim)).astype(np.float64)
        centres = points[:_CENTRES].copy()
        for _ in range(5):
            near = np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            for k in np.unique(near):
                centres[k] = points[near == k].mean(axis=0)
        found[int(dim)] = centres
    return found


def _placed(centres: dict[int, np.ndarray]):
    """Adds the nearest centre; 0 for a dimension count that the sample did not have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            near = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                c = centres.get(int(dim))
                if c is not None:
                    at = np.flatnonzero(dims == dim)
                    points = _matrix(batch.column("v").take(pa.array(at)), int(dim))
                    near[at] = np.argmax(
                        points.astype(float) @ c.T - (c**2).sum(axis=1) / 2, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near)], names=[*batch.schema.names, "centre"])

    return run


def _cut(size: int, whole_blocks: bool):
    """Sorted rows (vec_id, v, dim, centre) to rows of ``size`` vectors with a summary."""

    def made(ids: np.ndarray, m: np.ndarray, dim: int, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([dim], pa.int32()),
             pa.array([int(ids.min())], pa.int64()),
             pa.array([m.max(axis=0).tolist()], pa.list_(pa.int64())),
             pa.array([m.min(axis=0).tolist()], pa.list_(pa.int64())),
             pa.array([ids.astype("<i8").tobytes()], pa.binary()),
             pa.array([np.ascontiguousarray(m).astype("<i8").tobytes()], pa.binary())],
            names=["number", "dim", "least_id", "high", "low", "ids", "rows_"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest, rest_dim, rest_centre = 0, None, None, None
        for batch in batches:
            dims, near = batch.column("dim").to_numpy(), batch.column("centre").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            change = (dims[1:] != dims[:-1]) | (whole_blocks & (near[1:] != near[:-1]))
            edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(ids)]))
            for first, past in zip(edges[:-1], edges[1:]):
                if past == first:
                    continue
                dim, centre = int(dims[first]), int(near[first])
                part = (ids[first:past],
                        _matrix(batch.column("v").slice(first, past - first), dim))
                same = rest is not None and rest_dim == dim and (
                    not whole_blocks or rest_centre == centre)
                if same:
                    part = tuple(np.concatenate(x) for x in zip(rest, part))
                elif rest is not None:
                    yield made(*rest, rest_dim, number)
                    number += 1
                while len(part[0]) > size:
                    yield made(part[0][:size], part[1][:size], dim, number)
                    number += 1
                    part = tuple(x[size:] for x in part)
                rest, rest_dim, rest_centre = part, dim, centre
        if rest is not None:
            yield made(*rest, rest_dim, number)

    return run


_CUT_SCHEMA = ("number long, dim int, least_id long, high array<long>, low array<long>,"
               " ids binary, rows_ binary")


def _dealt(placed: DataFrame, size: int, whole_blocks: bool, key: str) -> DataFrame:
    """Blocks in the order of (dim, centre, vec_id), numbered by task and place."""
    ordered = placed.repartitionByRange("dim", "centre", "vec_id").sortWithinPartitions(
        "dim", "centre", "vec_id")
    cut = ordered.mapInArrow(_cut(size, whole_blocks), _CUT_SCHEMA)
    return cut.withColumn(key, F.spark_partition_id().cast("long") * F.lit(1 << 32)
                          + F.col("number")).drop("number")


def _stack(batch: pa.RecordBatch, k: int, name: str, dim: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_py(), "<i8").reshape(-1, dim)


def _bounded(seeds: int | None):
    """Rows (batch, queries, group of summaries, kth) to (batch, block, wanted queries).

    With ``seeds`` the blocks with the highest bounds per query of each group, else
    those that the k-th score so far does not rule out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                dim = rows.column("dim")[k].as_py()
                q = _stack(rows, k, "rows_", dim)
                group = rows.column("blocks")[k].as_py()
                high = np.array([b["high"] for b in group], np.int64)
                low = np.array([b["low"] for b in group], np.int64)
                bound = _products(np.maximum(q, 0), high) + _products(np.minimum(q, 0), low)
                if seeds is not None:
                    take = np.zeros(bound.shape, bool)
                    best = np.argsort(-bound, axis=1, kind="stable")[:, :seeds]
                    np.put_along_axis(take, best, True, axis=1)
                else:
                    kth = np.array([x["score"] for x in rows.column("kth")[k].as_py()])
                    last = np.array([x["vec_id"] for x in rows.column("kth")[k].as_py()])
                    least = np.array([b["least_id"] for b in group])
                    take = (bound > kth[:, None]) | (
                        (bound == kth[:, None]) & (least[None, :] < last[:, None]))
                used = np.flatnonzero(take.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("batch")[k].as_py()] * len(used), pa.int64()),
                     pa.array([group[j]["block"] for j in used], pa.int64()),
                     pa.array([np.flatnonzero(take[:, j]).tolist() for j in used],
                              pa.list_(pa.int64())),
                     pa.array([[int(x) for x in bound[take[:, j], j]] for j in used],
                              pa.list_(pa.int64()))],
                    names=["batch", "block", "wanted", "bounds"])

    return run


def _scored(k: int):
    """Rows (batch, queries, block rows, wanted) to the k best per query and block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                dim = rows.column("dim")[r].as_py()
                wanted = np.array(rows.column("wanted")[r].as_py(), np.int64)
                names = np.frombuffer(rows.column("query_ids")[r].as_py(), "<i8")[wanted]
                ids = np.frombuffer(rows.column("ids")[r].as_py(), "<i8")
                scores = _products(_stack(rows, r, "queries", dim)[wanted],
                                   _stack(rows, r, "rows_", dim))
                own = names[:, None] == ids[None, :]
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, own), axis=1)
                best = order[:, :k]
                i = np.repeat(np.arange(len(names)), best.shape[1])
                j = best.reshape(-1)
                other = ~own[i, j]
                i, j = i[other], j[other]
                batch = rows.column("batch")[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), batch)), pa.array(wanted[i]), pa.array(names[i]),
                     pa.array(ids[j]), pa.array(scores[i, j])],
                    names=["batch", "place", "query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, as an array in rank order."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    return found.groupBy("batch", "place", "query_id").agg(F.slice(ranked, 1, k).alias("best"))


def top_products(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with vec_id divisible by ``every``.

    table: (vec_id, embedding, ...). Candidates are all rows with another vec_id and as
    many components; ranked by inner product of floor(256 x), then by smaller vec_id.
    Fewer than ``k`` candidates give all of them. Vectors that are null, empty or hold a
    null or non-finite component, and rows without vec_id, take no part. Repeated rows
    are candidates each; a query that repeats vec_id and vector counts once. An empty
    table gives an empty result; other columns are not read.
    """
    scratch = Scratch(table.sparkSession, "products")
    vectors = whole_vectors(table)
    placed = vectors.mapInArrow(_placed(_centres(vectors)),
                                "vec_id long, v array<long>, dim int, centre long")
    blocks = scratch.save(_dealt(placed, _BLOCK, True, "block"), "blocks")
    asked = placed.where(f"vec_id % {every} = 0").dropDuplicates(["vec_id", "v"])
    queries = scratch.save(_dealt(asked, _BATCH, False, "batch"), "queries")

    summaries = blocks.select("block", "dim", "least_id", "high", "low")
    groups = max(1, -(-summaries.count() // _GROUP))
    grouped = summaries.groupBy("dim", F.expr(f"pmod(xxhash64(block), {groups})").alias("g")).agg(
        F.collect_list(F.struct("block", "least_id", "high", "low")).alias("blocks"))
    spread = queries.select("batch", "dim", "rows_").withColumn(
        "g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    met = spread.join(grouped, ["dim", "g"])
    pair = "batch long, block long, wanted array<long>, bounds array<long>"

    def score(pairs: DataFrame) -> DataFrame:
        of = queries.select("batch", F.col("rows_").alias("queries"),
                            F.col("ids").alias("query_ids"))
        full = pairs.join(of, "batch").join(blocks.select("block", "dim", "ids", "rows_"), "block")
        return full.select("batch", "dim", "queries", "query_ids", "wanted", "ids", "rows_") \
            .mapInArrow(_scored(k), "batch long, place long, query_id long, vec_id long, score long")

    # Of the best blocks of every group, the best of all.
    seeds = met.select("batch", "dim", "rows_", "blocks").mapInArrow(_bounded(_SEEDS), pair)
    chosen = seeds.select("batch", "block", F.explode(F.arrays_zip("wanted", "bounds")).alias("z")) \
        .groupBy("batch", F.col("z.wanted").alias("place")).agg(F.slice(F.sort_array(
            F.collect_list(F.struct((-F.col("z.bounds")).alias("b"), "block"))), 1, _SEEDS)
            .alias("s"))
    first = scratch.save(
        chosen.select("batch", "place", F.explode("s.block").alias("block"))
        .groupBy("batch", "block").agg(F.sort_array(F.collect_list("place")).alias("wanted")),
        "seeds")
    begun = scratch.save(score(first), "begun")

    # A query without k candidates yet rules nothing out.
    state = _best(begun, k).select("batch", "place", F.expr(
        f"CASE WHEN size(best) = {k} THEN struct(-best[{k - 1}].minus AS score,"
        f" best[{k - 1}].vec_id AS vec_id) END").alias("kth"))
    places = queries.select("batch", F.explode(F.expr(
        "sequence(0L, CAST(length(ids) div 8 - 1 AS BIGINT))")).alias("place"))
    none = F.expr("struct(-9223372036854775808L AS score, 9223372036854775807L AS vec_id)")
    kths = places.join(state, ["batch", "place"], "left").groupBy("batch").agg(F.expr(
        "transform(sort_array(collect_list(struct(place, kth))), x -> x.kth)").alias("kth")) \
        .withColumn("kth", F.transform("kth", lambda x: F.coalesce(x, none)))
    left = met.join(kths, "batch").select("batch", "dim", "rows_", "blocks", "kth") \
        .mapInArrow(_bounded(None), pair).drop("bounds")
    # What the first round has scored is not scored again.
    done = first.select("batch", "block", F.col("wanted").alias("done"))
    left = left.join(done, ["batch", "block"], "left").select(
        "batch", "block", F.expr("CASE WHEN done IS NULL THEN wanted"
                                 " ELSE array_except(wanted, done) END").alias("wanted"))
    everything = begun.union(score(left.where("size(wanted) > 0")))
    return _best(everything, k).select("query_id", F.posexplode("best").alias("r", "b")).select(
        "query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.minus")).alias("score"))
