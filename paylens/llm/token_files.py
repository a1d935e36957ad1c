"""Token ids in compressed files with a shared dictionary.

Ids are serialized as little-endian unsigned 16- or 32-bit integers, whichever the
vocabulary needs, and every document is compressed on its own with a zstandard
dictionary trained on serialized id arrays of a bounded sample. A file holds

    magic "PLT1" | id width, 1 byte | dictionary hash, 8 bytes | documents, 4 bytes
    then per document: doc_id, 8 bytes | offset, 8 bytes | ids, 4 bytes
    then the frames, offsets counted from the first of them

all little-endian; a null doc_id is the smallest 64-bit integer. One document is
read with the index and its own frame. Files are limited in size, cover ranges of
ascending doc_id, and are stored as rows (shard, part, first_id, data) of the Parquet
table ``files``, so that any storage that Spark can reach will do. The dictionary lies
beside it, as the row (hash, data) of the Parquet table ``dictionary``.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import slices
from .byte_pairs import is_space
from .scratch import Scratch

_MAGIC = b"PLT1"
_HEAD = struct.Struct("<4sBQI")
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("ids", "<u4")])
_FILE_BYTES = 4 << 20  # a file is closed beyond that
_NO_ID = -(1 << 63)
_REMEMBERED = 400_000  # stretches a worker keeps
_TEXT_AT_ONCE = 6 << 20  # bytes whose different stretches are looked up together
_RUN = 200  # stretches encoded as one text
_AT_ONCE = 1_000  # texts per call


def _stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which texts may be cut, and those at which they begin.

    Text ``i`` is the UTF-8 ``data[offsets[i]:offsets[i + 1]]``. A text may be cut before a
    blank between two other characters: the byte-level vocabulary's pattern never joins
    across, as a word takes at most the blank before it.
    """
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    solid = ~is_space()[points]
    edges = np.searchsorted(leads, offsets)  # in code points
    inner = np.ones(len(points) + 1, bool)
    inner[edges] = False  # where a text begins
    cut = np.zeros(len(points), bool)
    cut[1:-1] = ((points[1:-1] == ord(" ")) & solid[:-2] & solid[2:]
                 & inner[1:-2] & inner[2:-1])
    cut[edges[:-1][offsets[1:] > offsets[:-1]]] = True
    return leads[cut]


class Encoder:
    """Ids of texts by the tokenizers library; stretches between blanks are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():  # one character stands for one byte
            self._bytes[number] = len(token)
        self._row: dict[bytes, int] = {}
        self._ids, self._first = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self._uses = np.zeros(0, np.float32)  # lately, in calls

    def _forget(self) -> None:
        """Forgets the half that was used least; of equally used ones what was learned first."""
        kept = np.sort(np.argsort(self._uses, kind="stable")[len(self._row) // 2:])
        mask = np.zeros(len(self._row), bool)
        mask[kept] = True
        # Stretches are in the order of their rows.
        self._row = {s: row for row, s in enumerate(compress(self._row, mask.tolist()))}
        self._ids, past = self._ids_of(kept)
        self._first = np.append(0, past)
        self._uses = self._uses[kept] / 2

    def _ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and where those of each row end."""
        counts = self._first[rows + 1] - self._first[rows]
        past = np.cumsum(counts)
        places = np.repeat(self._first[rows] - past + counts, counts)
        places += np.arange(len(places))
        return self._ids[places], past

    def _learn(self, stretches: list[bytes]) -> None:
        """Ids of new stretches.

        Those that may stand side by side are encoded in runs, as an encoding of its own for
        each word costs more than the word; the bytes of the tokens tell where a word ends.
        """
        alone, side_by_side = [], []
        for s in stretches:
            t = s.decode()
            joins = t[0] == " " and not t[1:2].isspace() and not t[-1].isspace()
            (side_by_side if joins and len(t) > 1 else alone).append(s)
        held, sizes = [self._ids], []
        runs = [side_by_side[k:k + _RUN] for k in range(0, len(side_by_side), _RUN)]
        for run, made in zip(runs, self._encoded([b"".join(run) for run in runs])):
            ids = np.array(made, self.kind)
            ends = np.cumsum(self._bytes[ids])
            wanted = np.cumsum([len(s) for s in run])
            past = np.searchsorted(ends, wanted) + 1
            if not len(ids) or not np.array_equal(ends[np.minimum(past, len(ids)) - 1], wanted):
                alone += run  # the vocabulary's tokens are not the bytes of the text
                continue
            self._remember(run)
            held.append(ids)
            sizes.append(np.diff(past, prepend=0))
        made = self._encoded(alone)
        self._remember(alone)
        held.append(np.fromiter((i for ids in made for i in ids), self.kind))
        sizes.append(np.array([len(ids) for ids in made], np.int64))
        past = self._first[-1] + np.cumsum(np.concatenate(sizes))
        self._first = np.concatenate((self._first, past))
        self._ids = np.concatenate(held)

    def _encoded(self, texts: list[bytes]) -> list[list[int]]:
        found = []
        for first in range(0, len(texts), _AT_ONCE):  # without the places of ids in the text
            part = [t.decode() for t in texts[first:first + _AT_ONCE]]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(
                part, add_special_tokens=False)]
        return found

    def _remember(self, stretches: list[bytes]) -> None:
        self._row.update(zip(stretches, range(len(self._row), len(self._row) + len(stretches))))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and where those of each text end. Null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, buffer, raw = texts.buffers()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if buffer is not None and len(texts):
            offsets = np.frombuffer(buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = _stretches(data, offsets)
        # Stretches lie side by side, so the texts themselves are the data of an array of them.
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        ).dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        if len(self._row) > _REMEMBERED:
            self._forget()
        rows = np.fromiter(map(self._row.get, stretches, repeat(-1)), np.int64, len(stretches))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = [stretches[k] for k in missing.tolist()]
            self._learn(new)
            rows[missing] = np.fromiter(map(self._row.__getitem__, new), np.int64, len(new))
            self._uses = np.append(self._uses, np.zeros(len(new), np.float32))
        self._uses[rows] += 1
        ids, past = self._ids_of(rows[coded.indices.to_numpy()])
        return ids, np.append(0, past)[np.searchsorted(starts, offsets[1:])]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Serialized ids of every text."""
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        raw, width = memoryview(ids.tobytes()), ids.itemsize
        places = [0, *(ends * width).tolist()]
        return [bytes(raw[a:b]) for a, b in zip(places, places[1:])]


_ENCODERS: dict[str, Encoder] = {}  # one per worker, with what it remembers


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _sample(batches: Iterable[pa.RecordBatch], encoder: Encoder) -> list[bytes]:
    return [x for batch in batches for x in encoder.encode(
        [t or "" for t in batch.column("text").to_pylist()])]


def dictionary(docs: DataFrame, tokenizer: str, rows: int = 2_000, piece: int = 2_048,
               size: int = 65_536) -> bytes:
    """A zstandard dictionary from about ``rows`` documents (all, if fewer), by a hash of doc_id.

    Of each the first ``piece`` bytes of ids are used, which bounds the training; it
    decides on the compression only, never on what a file holds.
    """
    import zstandard

    share = min(1.0, rows / max(1, docs.count()))
    chosen = docs.where(F.expr(f"pmod(xxhash64(doc_id), 1000003) < {share} * 1000003D"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [x[:piece] for x in _sample(batches, _encoder(tokenizer))]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["ids"])

    held = chosen.select(F.substring("text", 1, 8 * piece).alias("text")) \
        .mapInArrow(run, "ids binary").toArrow().column("ids").to_pylist()
    samples = sorted(x for x in held if x)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # too little to train on: frames then stand without a dictionary


def dictionary_hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def _tools(data: bytes):
    import zstandard

    if not data:
        return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    shared = zstandard.ZstdCompressionDict(data)
    return (zstandard.ZstdCompressor(level=3, dict_data=shared),
            zstandard.ZstdDecompressor(dict_data=shared))


def pack(documents: list[tuple[int, bytes, int]], mark: int, width: int) -> bytes:
    """A file from (doc_id, frame, number of ids)."""
    index = np.zeros(len(documents), _ENTRY)
    sizes = [len(f) for _, f, _ in documents]
    index["doc_id"] = [d for d, _, _ in documents]
    index["offset"] = np.concatenate(([0], np.cumsum(sizes)[:-1])) if sizes else []
    index["ids"] = [n for _, _, n in documents]
    return b"".join([_HEAD.pack(_MAGIC, width, mark, len(documents)), index.tobytes(),
                     *[f for _, f, _ in documents]])


def unpack(data: bytes, shared: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids as unsigned 32-bit) of every document of a file, in order."""
    magic, width, mark, count = _HEAD.unpack_from(data)
    if magic != _MAGIC or mark != dictionary_hash(shared):
        raise ValueError("not a token file, or one with another dictionary")
    index = np.frombuffer(data, _ENTRY, count, _HEAD.size)
    base = _HEAD.size + index.nbytes
    ends = np.append(index["offset"][1:], len(data) - base)
    _, reader = _tools(shared)
    for entry, end in zip(index, ends):
        frame = data[base + int(entry["offset"]):base + int(end)]
        raw = reader.decompress(frame, max_output_size=int(entry["ids"]) * width)
        yield int(entry["doc_id"]), np.frombuffer(raw, f"<u{width}").astype("<u4")


def one_document(data: bytes, shared: bytes, doc_id: int) -> np.ndarray:
    """The ids of one document, from the index and its own frame alone."""
    _, width, _, count = _HEAD.unpack_from(data)
    index = np.frombuffer(data, _ENTRY, count, _HEAD.size)
    k = int(np.searchsorted(index["doc_id"], doc_id))
    if k == count or index["doc_id"][k] != doc_id:
        raise KeyError(doc_id)
    base = _HEAD.size + index.nbytes
    end = int(index["offset"][k + 1]) if k + 1 < count else len(data) - base
    raw = _tools(shared)[1].decompress(data[base + int(index["offset"][k]):base + end],
                                       max_output_size=int(index["ids"][k]) * width)
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def write_files(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch,
                shared: bytes) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the files; (shard, part, first_id, data).

    Shards are ranges of doc_id, ascending; so are the documents of a shard. The dictionary
    is written with them: the folder of ``scratch`` is all that a reader needs.
    """
    mark = dictionary_hash(shared)
    spark = docs.sparkSession
    scratch.save(spark.createDataFrame(
        [(f"{mark:016x}", bytearray(shared))], "hash string, data binary"), "dictionary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (writer, _) = _encoder(tokenizer), _tools(shared)
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        held, size, part = [], 0, 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([held[0][0]], pa.int64()),
                 pa.array([pack(held, mark, width)], pa.large_binary())],
                names=["part", "first_id", "data"])

        for batch in batches:
            for some in slices(batch, size=_TEXT_AT_ONCE):
                ids, ends = encoder.encode_array(some.column("text"))
                places = [0, *ends.tolist()]
                for name, a, b in zip(some.column("doc_id").to_pylist(), places, places[1:]):
                    raw = ids[a:b].tobytes() + end
                    frame = writer.compress(raw)
                    held.append((_NO_ID if name is None else name, frame, len(raw) // width))
                    size += len(frame)
                    if size >= _FILE_BYTES:
                        yield close()
                        held, size, part = [], 0, part + 1
        if held:
            yield close()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    dealt = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(run, "part long, first_id long, data binary")
    return scratch.save(files.withColumn("shard", F.spark_partition_id()), "files")


def stored_dictionary(spark: SparkSession, folder: str) -> bytes:
    """The dictionary of the files in a folder that ``write_files`` wrote."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.data)
    if row.hash != f"{dictionary_hash(data):016x}":
        raise ValueError(f"{folder}: not the dictionary of its hash")
    return data


def find_document(spark: SparkSession, folder: str, doc_id: int) -> np.ndarray:
    """The ids of one document of a folder of files; KeyError if there is none of that id.

    Only the file that may hold it is read. Of repeated ids the one that is met first.
    """
    files = spark.read.parquet(f"{folder}/files").where(F.col("first_id") <= doc_id)
    last = files.agg(F.max("first_id")).first()[0]
    if last is None:
        raise KeyError(doc_id)
    held = files.where(F.col("first_id") == last).orderBy(
        F.desc("shard"), F.desc("part")).select("data").first().data
    return one_document(held, stored_dictionary(spark, folder), doc_id)


def read_back(files: DataFrame, shared: bytes) -> DataFrame:
    """(doc_id, shard, part, place, n_tokens, ids_crc32) of every document in the files."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, data in zip(*(batch.column(c).to_pylist()
                                           for c in ("shard", "part", "data"))):
                ids, counts, sums = [], [], []
                for doc_id, values in unpack(data, shared):
                    ids.append(None if doc_id == _NO_ID else doc_id)
                    counts.append(len(values))
                    sums.append(zlib.crc32(values.tobytes()))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([shard] * n, pa.int32()),
                     pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "shard", "part", "place", "n_tokens", "ids_crc32"])

    return files.select("shard", "part", "data").mapInArrow(
        run, "doc_id long, shard int, part long, place long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files written.

    docs: (doc_id, text, ...). Null texts are empty and have the end id alone. Files are
    in ascending doc_id order (rows without one first, repeated ids by text); ``start``
    counts the ids of all documents before. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    shared = dictionary(docs.select("doc_id", "text"), tokenizer)
    files = write_files(docs, tokenizer, end_id, scratch, shared)
    stored = stored_dictionary(docs.sparkSession, scratch.folder)
    found = scratch.save(read_back(files, stored), "index")
    # Prefix sums in two steps: over the files (few), then inside each.
    totals = found.groupBy("shard", "part").agg(F.sum("n_tokens").alias("held"))
    shards = totals.groupBy("shard").agg(F.sum("held").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("within", F.coalesce(F.sum("held").over(ahead), F.lit(0))) \
        .join(shards, "shard").select("shard", "part", (F.col("base") + F.col("within")).alias("b"))
    inside = Window.partitionBy("shard", "part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    return found.withColumn("w", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))) \
        .join(bases, ["shard", "part"]).select(
            "doc_id", (F.col("b") + F.col("w")).alias("start"), "n_tokens", "ids_crc32")
