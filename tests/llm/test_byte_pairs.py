import base64
import hashlib
import random

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from paylens.llm import byte_pairs
from paylens.llm.byte_pairs import (
    Codec, Vocabulary, codec, decoded, digests, encoded, many_languages, piece_starts,
)

PATH = many_languages()
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "a b's'tre ve ll dm  \n\t\x85　\x1c12½²éß你好😀!?.,'\"ʼＡ٣"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(seed, count):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
             for _ in range(count)]
    return texts + [
        "", " ", "  ", "\n", "'re", "'r", "'l", "x'l", "'ll's", "\n\n've", " 's", "!'s", "''s",
        "a" * 500, " " * 300, "ab" * 700, "=" * 1000, "tion" * 90, "é" * 200]


@pytest.mark.parametrize("window, block", [(1 << 20, 256), (97, 16), (1, 4)])
def test_ids_equal_the_library(monkeypatch, window, block):
    """Also when a window, or a block of the scan, ends anywhere inside a text."""
    monkeypatch.setattr(byte_pairs, "_WINDOW", window)
    monkeypatch.setattr(byte_pairs, "_BLOCK", block)
    texts = random_texts(1, 40 if window == 1 else 4000)
    ids, ends, counts = codec(PATH).encode(pa.array(texts))
    past = np.cumsum(counts)
    for text, count, end in zip(texts, counts, past):
        own = ids[end - count:end].tolist()
        assert own == LIBRARY.encode_ordinary(text), repr(text)
        lengths = [len(LIBRARY.decode_single_token_bytes(i)) for i in own]
        assert ends[end - count:end].tolist() == np.cumsum(lengths).astype(int).tolist()


def test_long_and_short_pieces_merge_alike():
    words = [bytes(random.Random(k).choices(b"aeionst", k=20)) for k in range(500)]
    vocabulary = Vocabulary(PATH)
    flat, counts = byte_pairs._merge_short(words, vocabulary)
    for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == byte_pairs._merge_long(word, vocabulary.ranks)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_pairs, "_REMEMBERED", 50)
    tool = Codec(Vocabulary(PATH))
    for k in range(5):
        texts = random_texts(k, 100)
        ids, _, counts = tool.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in LIBRARY.encode_ordinary(t)]


def test_pieces_cover_the_text():
    data = "it's  ok\n 12 don't".encode()
    starts = piece_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    cuts = [*starts.tolist(), len(data)]
    assert [data[a:b] for a, b in zip(cuts, cuts[1:])] == [
        b"it", b"'s", b" ", b" ok", b"\n", b" 12", b" don", b"'t"]


def test_digests_of_awkward_rows(spark):
    rows = cases.awkward() + [cases.row(30, "it's " * 40_000), cases.row(31, "x" * 30_000)]
    got = digests(cases.frame(spark, rows), PATH).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_all_columns_stay_and_a_stretch_decodes_alone(spark):
    made = encoded(cases.frame(spark), PATH)
    for line in made.collect():
        text = (line.row_.text or "").encode()
        assert line.row_["a.b"] == 0 and line.row_.key == "k"
        if len(line.ids) > 4:
            part = b"".join(codec(PATH).decode(np.array(line.ids[2:4])).to_pylist())
            assert part == text[line.ends[1]:line.ends[3]]


def test_decoding_apart_and_at_once(spark, monkeypatch):
    monkeypatch.setattr(byte_pairs, "_IDS_AT_ONCE", 100)
    made = encoded(cases.frame(spark), PATH, ["doc_id", "text"], decode=True)
    apart = decoded(made.drop("decoded"), PATH)
    assert sorted(map(str, apart.collect())) == sorted(
        map(str, made.select("row_", "ids", "decoded").collect()))
    assert made.where("decoded <> CAST(coalesce(row_.text, '') AS BINARY)").count() == 0
    assert made.count() == apart.count() == len(cases.awkward())


def test_ids_of_another_vocabulary_are_refused(spark):
    made = encoded(cases.frame(spark).where("doc_id = 7"), PATH)
    with pytest.raises(Exception, match="do not belong together"):
        decoded(made.selectExpr("row_", "reverse(ids) AS ids", "ends"), PATH).collect()
    lost = made.selectExpr("row_", "CAST(NULL AS ARRAY<INT>) AS ids",
                           "CAST(NULL AS ARRAY<INT>) AS ends")
    assert decoded(lost, PATH).first().decoded is None


def test_empty_table_and_bytes_that_are_no_text(spark):
    assert digests(cases.frame(spark, []), PATH).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert digests(odd, PATH).first().decoded_sha256 == sha("a\ufffdb")
