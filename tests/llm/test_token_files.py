import os
import random
import subprocess
import sys
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paylens.llm import token_files
from paylens.llm.scratch import Scratch
from paylens.llm.token_files import (
    Encoder, dictionary, dictionary_hash, find_document, one_document, pack, token_index, unpack,
    write_files,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_stretches_equal_whole_texts():
    rnd = random.Random(3)
    alphabet = "ab th'sé \n\t    \x85\x1c1.,!"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|>", " x", "x ", "a\n b", "it's  ok", "   ", ""]
    encoder = Encoder(PATH)
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, encoder.kind).tolist() == ids_of(text)[:-1], repr(text)


def test_stretches_encoded_in_runs_and_alone(monkeypatch):
    """Whatever is remembered, and however many stretches make a run."""
    rnd = random.Random(4)
    words = ["ab", "thé", "<|endoftext|>", "你好", "it's", "12½", "\u3000x", "a\x1c", "😀", "\n", ""]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    for run, remembered in ((1, 10), (3, 10**6), (10**6, 10**6)):
        monkeypatch.setattr(token_files, "_RUN", run)
        monkeypatch.setattr(token_files, "_REMEMBERED", remembered)
        encoder = Encoder(PATH)
        for first in range(0, 400, 50):
            some = texts[first:first + 50]
            for text, got in zip(some, encoder.encode(some)):
                assert np.frombuffer(got, encoder.kind).tolist() == ids_of(text)[:-1], repr(text)
    # A vocabulary whose tokens are not the bytes of the text is told, and encoded word by word.
    encoder = Encoder(PATH)
    encoder._bytes[:] = 1
    assert np.frombuffer(encoder.encode(["some words here"])[0], encoder.kind).tolist() == ids_of(
        "some words here")[:-1]


def test_what_is_used_often_is_kept(monkeypatch):
    """A few words of every text, learned first, and many that are met once."""
    monkeypatch.setattr(token_files, "_REMEMBERED", 100)
    encoder, learned = Encoder(PATH), []
    real = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(new), real(new)))
    common = [f"common{chr(97 + k)}" for k in range(20)]
    for n in range(30):
        text = " ".join(["first", *common, *[f"once{n}x{k}" for k in range(20)]])
        got = np.frombuffer(encoder.encode([text])[0], encoder.kind)
        assert got.tolist() == ids_of(text)[:-1]
    assert len(encoder._row) == len(encoder._uses) == len(encoder._first) - 1 <= 120
    assert [learned.count(f" {word}".encode()) for word in common] == [1] * 20


def test_index_of_awkward_rows(spark):
    rows = cases.awkward()
    got = token_index(cases.frame(spark, rows), PATH).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for doc_id, text, *_ in ordered:
        ids = ids_of(text)
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_files_and_single_documents(spark):
    docs = cases.frame(spark).where("doc_id > 3").dropDuplicates(["doc_id"])
    shared = dictionary(docs, PATH)
    files = write_files(docs, PATH, 2, Scratch(spark, "test"), shared).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for file in sorted(files, key=lambda f: (f.shard, f.part)):
        for doc_id, ids in unpack(file.data, shared):
            assert ids.tolist() == ids_of(texts[doc_id])
            assert one_document(file.data, shared, doc_id).tolist() == ids.tolist()
            seen.append(doc_id)
        with pytest.raises(KeyError):
            one_document(file.data, shared, 10**9)
    assert seen == sorted(texts)


def test_a_new_process_reads_a_document(spark):
    """From the files alone, without Spark or anything that the writer knew."""
    docs = cases.frame(spark).where("doc_id > 3").dropDuplicates(["doc_id"])
    scratch = Scratch(spark, "test")
    write_files(docs, PATH, 2, scratch, dictionary(docs, PATH))
    text = docs.where("doc_id = 14").first().text
    assert find_document(spark, scratch.folder, 14).tolist() == ids_of(text)
    for missing in (3, 10**9):
        with pytest.raises(KeyError):
            find_document(spark, scratch.folder, missing)
    code = """
import sys
import pyarrow.parquet as pq
from paylens.llm.token_files import one_document
folder = sys.argv[1].removeprefix("file:")
files = pq.read_table(folder + "/files", columns=["first_id", "data"]).to_pylist()
shared = pq.read_table(folder + "/dictionary").to_pylist()[0]["data"]
held = max((f for f in files if f["first_id"] <= 14), key=lambda f: f["first_id"])["data"]
print(*one_document(held, shared, 14).tolist())
"""
    made = subprocess.run([sys.executable, "-c", code, scratch.folder], capture_output=True,
                          text=True, check=True, env={**os.environ, "PYTHONPATH": REPO})
    assert list(map(int, made.stdout.split())) == ids_of(text)


def test_another_dictionary_is_refused():
    data = pack([], dictionary_hash(b"one"), 2)
    assert list(unpack(data, b"one")) == []
    with pytest.raises(ValueError):
        list(unpack(data, b"two"))


def test_empty_table(spark):
    assert token_index(cases.frame(spark, []), PATH).count() == 0
