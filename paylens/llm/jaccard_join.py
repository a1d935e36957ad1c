"""N-gram Jaccard join with prefix filters under several global token orders.

Let t be the threshold and m(n) = n - ceil(t n), the most shingles of an n-set
that a partner can lack.

1. *First order, hash values.* Of every set the 2 m + 1 smallest hashes are kept;
   linked sets share at least m of those (m + 1 if they are equally large).
2. *Second order, rarity within these lists.* A shingle that one set alone lists
   costs nothing further; of the others only the rarest go on, as many as a
   prefix filter for m common entries needs. Wide-spread passages come last,
   so a set takes part only if most of its list is shared with others.
3. *Third and fourth order, other hash functions.* Candidates must also share one
   of their m + 1 smallest entries under each; all filters have to agree.
4. *Verification* intersects whole sets.

Equal sets are one class from the start. The lists of all shingles that have the
same leader (one class per list, chosen by one order of the classes) are merged,
and each class is compared with its leaders first. Only where a merged list then
holds several components, the rest of its pairs is looked at: in blocks of
bounded size, by a bound on the symmetric difference from two 1,024-bit parity
vectors, which is never above the true one. First every class is compared with its
nearest ones of other components alone, which unites most of them; then all pairs
that still lie in different components follow, so none is left out. Of thousands of
near copies, a few pairs for each leave the blocks, not their square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, shingles, slices, words
from .components import components
from .scratch import Scratch

_BLOCK = 512  # classes in one side of a block
_BITS = 1024  # of a parity vector
_NEAREST = 8  # pairs of a class that are looked at before all others
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def missing(n, percent: int):
    """Most elements of an n-set that a partner at the threshold can lack."""
    return n - (n * percent + 99) // 100


def _linkable(n, percent: int):
    """Sets too small to reach the threshold with any different set take no part."""
    return n * 100 >= (n + 1) * percent


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, values in enumerate(shingles(words(batch.column("text")), n)):
        yield i, np.unique(values)


def _class(values: np.ndarray) -> int:
    total = mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(_signed(mixed(np.array([total + np.uint64(len(values))], np.uint64)))[0])


def _parity(values: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of elements falls on k."""
    places = (mixed(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(_BITS)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=_BITS) & 1).tobytes()


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(flat)))


def _describe(n: int, percent: int):
    """Per row: id, set size, class of equal sets, and the list under the first order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes, classes, lists = [], [], []
                for _, s in _sets(batch, n):
                    size = len(s)
                    sizes.append(size)
                    classes.append(_class(s) if size else None)
                    keep = 2 * missing(size, percent) + 1 if _linkable(size, percent) else 0
                    lists.append(s[:keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array(classes, pa.int64()), _lists(lists)],
                    names=["doc_id", "n", "fp", "keys"])

    return run


def _whole_sets(n: int, percent: int):
    """Per row: class, size, whole set, parity vector, prefixes under the further orders."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [s for _, s in _sets(batch, n) if len(s)]
                prefixes = []
                for seed in _SEEDS:
                    cut = []
                    for s in rows:
                        keep = missing(len(s), percent) + 1
                        order = mixed(s ^ seed)
                        near = np.argpartition(order, keep - 1)[:keep] if keep < len(s) else None
                        cut.append(s if near is None else s[near])
                    prefixes.append(_lists(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class(s) for s in rows], pa.int64()),
                     pa.array([len(s) for s in rows], pa.int64()), _lists(rows),
                     pa.array([_parity(s) for s in rows], pa.binary()), *prefixes],
                    names=["fp", "n", "items", "parity", "third", "fourth"])

    return run


def _prefixes(described: DataFrame, percent: int) -> DataFrame:
    """(token, fp, n): the list entries that can lead to a partner."""
    posted = described.select(F.explode("keys").alias("token"), "fp", "n").repartition("token")
    shared = posted.groupBy("token").agg(
        F.count(F.lit(1)).alias("spread"), F.min("fp").alias("low"), F.max("fp").alias("high"),
    ).where("low <> high").select("token", "spread")
    # Same partitioning on both sides; the shared tokens are the small, hashed one.
    met = posted.join(shared.hint("shuffle_hash"), "token").dropDuplicates(["token", "fp"])
    met = met.select("fp", "n", F.struct("spread", "token").alias("entry"))
    # A class has at most 2 m(n) + 1 entries, so the gathered array is bounded by one set.
    gathered = met.groupBy("fp", "n").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    # The list has 2 m + 1 entries and at least m common ones, so m + 2 are its prefix;
    # unshared entries, 2 m + 1 - size of them, come first.
    allowed = f"CAST(size(entries) - (n - (n * {percent} + 99) div 100) + 1 AS INT)"
    cut = gathered.where(f"{allowed} > 0").select(
        "fp", "n", F.explode(F.expr(f"slice(entries, 1, least({allowed}, size(entries)))")).alias("e"))
    return cut.select(F.col("e.token").alias("token"), "fp", "n")


def _near_size(a: str, b: str, percent: int) -> Column:
    return F.expr(f"least({a}, {b}) * 100 >= greatest({a}, {b}) * {percent}")


def _led(members: DataFrame, percent: int) -> DataFrame:
    """(lead, lead_n, fp, n): every class with the leaders of its lists, the leader included."""
    place = F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("lead"),
                     F.col("n").alias("lead_n"))
    leaders = members.groupBy("token").agg(F.min(place).alias("l")).select("token", "l.*")
    return members.join(leaders, "token").select("lead", "lead_n", "fp", "n").distinct()


def _near_in_block(left: dict, right: dict, percent: int,
                   nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs between two sides that size and parity vectors allow.

    With ``nearest`` only so many for each class of the left side, nearest first.
    """
    both = left["n"][:, None] + right["n"][None, :]
    low = np.minimum(left["n"][:, None], right["n"][None, :])
    fits = (low * 100 >= (both - low) * percent) \
        & (left["root"][:, None] != right["root"][None, :])
    i, j = np.nonzero(fits)
    bits = np.bitwise_count(left["parity"][i] ^ right["parity"][j]).sum(axis=1, dtype=np.int64)
    near = bits * (100 + percent) <= (100 - percent) * both[i, j]
    i, j = i[near], j[near]
    if nearest is None:
        return i, j
    order = np.lexsort((bits[near] / both[i, j], i))
    i, j = i[order], j[order]
    chosen = np.arange(len(i)) - np.searchsorted(i, i) < nearest
    return i[chosen], j[chosen]


def _block_pairs(percent: int, nearest: int | None):
    """Sorted rows (lead, i, j, side, fp, n, root, parity) to the pairs that stay possible."""

    def sides(rows: pa.Table) -> tuple[dict, dict]:
        side = rows["side"].to_numpy()
        parity = np.frombuffer(b"".join(rows["parity"].to_pylist()), np.uint64)
        whole = {"fp": rows["fp"].to_numpy(), "n": rows["n"].to_numpy(),
                 "root": rows["root"].to_numpy(), "parity": parity.reshape(len(side), -1)}
        left = {k: v[side == 0] for k, v in whole.items()}
        right = {k: v[side == 1] for k, v in whole.items()}
        return left, (right if len(right["fp"]) else left)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        left, right = sides(rows)
        out_a, out_b = [], []
        for first in range(0, len(left["fp"]), 128):  # bounds the matrices
            part = {k: v[first:first + 128] for k, v in left.items()}
            i, j = _near_in_block(part, right, percent, nearest)
            a, b = part["fp"][i], right["fp"][j]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        made = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            keys = np.stack([rows[c].to_numpy() for c in ("lead", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            first = 0
            for cut in cuts:
                yield pairs(rows.slice(first, cut - first))
                first = cut
            rest = rows.slice(first)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def _crossing(led: DataFrame, roots: DataFrame, sets: DataFrame, percent: int,
              nearest: int | None = None) -> DataFrame:
    """Pairs of one merged list and two components that may still be linked."""
    found = led.select("lead", "fp", "n").join(
        roots.withColumnRenamed("node", "fp"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    split = found.groupBy("lead").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"),
    ).where("lo <> hi").select("lead", F.expr(f"CAST((size - 1) div {_BLOCK} + 1 AS INT) AS k"))
    rows = found.join(split, "lead").join(sets.select("fp", "parity"), "fp").withColumn(
        "own", F.expr("CAST(pmod(xxhash64(fp), k) AS INT)"))
    # Block (i, j), i <= j, holds the classes of part i as side 0 and of part j as side 1.
    spread = rows.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select(
        "lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "fp", "n", "root", "parity")
    dealt = spread.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return dealt.mapInArrow(_block_pairs(percent, nearest), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass every filter and reach the threshold."""
    def side(key: str, mark: str) -> DataFrame:
        return sets.select(F.col("fp").alias(key), *[
            F.col(c).alias(f"{mark}_{c}") for c in ("n", "items", "third", "fourth")])

    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    met = met.where("arrays_overlap(x_third, y_third) AND arrays_overlap(x_fourth, y_fourth)")
    met = met.select("a", "b", (F.col("x_n") + F.col("y_n")).alias("both"),
                     F.expr("size(array_intersect(x_items, y_items))").alias("common"))
    return met.where(f"common * 100 >= (both - common) * {percent}").select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    Two rows link if their sets of ``n``-word shingles (A-Z folded; fewer words
    form one shingle) have 100 |A and B| >= percent |A or B|. ``component_id`` is
    the smallest doc_id reachable by links. Sets are compared by 64-bit hashes.

    Null, empty and blank texts have no shingles, link with nothing and keep
    their own id. Rows that repeat a doc_id are one document: each is described
    on its own, and all with words are in one component. Rows without doc_id keep
    null. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    schema = "doc_id long, n long, fp long, keys array<long>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    described = scratch.save(source.mapInArrow(_describe(n, percent), schema), "described")

    known = described.where("fp IS NOT NULL")
    members = scratch.save(_prefixes(known, percent), "members")
    same = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    tied = known.join(same, "doc_id").select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    links = scratch.save(tied.where("a <> b"), "links-tied")

    sets = scratch.save(_needed_sets(source, known, members, n, percent), "sets")
    led = scratch.save(_led(members, percent), "led")
    with_leader = led.where("fp <> lead").where(_near_size("n", "lead_n", percent)).select(
        F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()
    found = _verified(with_leader, sets, percent)
    roots = components(links.union(found), scratch, "roots-1")
    for step, nearest in enumerate((_NEAREST, None), start=2):
        crossing = _verified(_crossing(led, roots, sets, percent, nearest), sets, percent)
        tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(tied.union(crossing), scratch, f"roots-{step}")
    scratch.drop("sets", "led", "members")

    placed = described.select("doc_id", "n", "fp").join(
        roots.withColumnRenamed("node", "fp"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _needed_sets(source: DataFrame, known: DataFrame, members: DataFrame, n: int,
                 percent: int) -> DataFrame:
    """Whole sets of the classes in ``members``, one row per class."""
    wanted = members.select("fp").distinct()
    one = known.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(wanted, "fp", "left_semi")
    texts = source.join(one.select("doc_id").distinct(), "doc_id", "left_semi")
    schema = ("fp long, n long, items array<long>, parity binary, third array<long>,"
              " fourth array<long>")
    made = texts.mapInArrow(_whole_sets(n, percent), schema)
    return made.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays.

    That row is one with the component's smallest doc_id. Rows that repeat a doc_id
    are one document, of which the longest text stays. Texts without a word have no
    copies; rows without doc_id are never dropped.
    """
    found = jaccard_components(docs.select("doc_id", "text"), n, percent)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return _without_repeats(kept)


def _without_repeats(docs: DataFrame) -> DataFrame:
    """One row of each doc_id that is there."""
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows_")).where("rows_ > 1").select("doc_id")
    chosen = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
        F.struct(F.length("text"), F.xxhash64("text"))).alias("whole"))
    return docs.join(several, "doc_id", "left_anti").union(chosen.select("whole.*"))
