import random
import zlib

import cases
import numpy as np
import sentencepiece

from paylens.llm import sentence_pieces
from paylens.llm.sentence_pieces import (
    Search, Vocabulary, decoded, digests, encoded, piece_model,
)

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model())


def ids_of(text):
    return LIBRARY.encode(text or "")


def test_random_texts_equal_the_library():
    search, rnd = Search(Vocabulary(piece_model())), random.Random(5)
    alphabet = "aeioutnrs  \n\tßéñ▁你😀.,!AB012 　²"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "   a", "a  b   ", "\n", "<s>", "a\x00b", "h" * 300, "ab" * 500,
              "tion" * 90, " " * 70, "=" * 100]
    for text in texts:
        ids = search.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text), repr(text)
        assert search.decode(ids) == text.replace("▁", " ")


def test_ids_are_final_before_the_text_ends():
    """Long stretches leave the window in parts, and the parts make up the whole."""
    search = Search(Vocabulary(piece_model()))
    parts = list(search.stream(["tionthe" * 40] * 3))
    assert len(parts) > 3
    whole = np.frombuffer(b"".join(parts), "<u4").tolist()
    assert "".join(LIBRARY.id_to_piece(i) for i in whole) == "tionthe" * 120


def test_full_memory_forgets_no_stretch_in_use(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "_REMEMBERED", 20)
    search, rnd, searched = Search(Vocabulary(piece_model())), random.Random(8), []
    whole = search._ids_of
    monkeypatch.setattr(search, "_ids_of", lambda s: searched.append(s) or whole(s))
    for _ in range(300):
        text = "often " + "".join(rnd.choice("aeiontrs") for _ in range(rnd.randint(1, 30)))
        assert np.frombuffer(search.encode(text), "<u4").tolist() == ids_of(text)
    assert searched.count("▁often") == 1


def test_common_beginnings_are_searched_once():
    search = Search(Vocabulary(piece_model()))
    search.encode("unfathomable")
    before = len(search._ends)
    for text in ("unfathomably", "unfathomablest", "unfathom"):
        assert np.frombuffer(search.encode(text), "<u4").tolist() == ids_of(text)
    assert len(search._ends) == before + 3


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    found = encoded(docs, piece_model())
    got = found.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == ids_of(r.row_.text)
    back = decoded(found, piece_model()).collect()
    assert all(r.decoded == (r.row_.text or "") for r in back)
    assert found.select("row_.*").columns == docs.columns
    for r in digests(docs, piece_model()).where("doc_id >= 7").collect():
        assert r.same and r.n_ids > 0
    ids = np.array(ids_of("One"), "<u4").tobytes()
    one = digests(docs.where("doc_id = 4"), piece_model()).first()
    assert (one.n_ids, one.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))


def test_empty_table(spark):
    assert encoded(cases.frame(spark, []), piece_model()).count() == 0
    assert digests(cases.frame(spark, []), piece_model()).count() == 0
