import random

import cases

from paylens.llm.language_id import identified, letters, train

WORDS = {
    "aa": ["bana", "kolo", "mira", "tasu"], "bb": ["strsch", "pflicht", "zwerg", "knopf"],
    "cc": ["êtoil", "mèche", "façon", "où"],
}


def rows(seed, per_lang, length):
    rnd = random.Random(seed)
    return [cases.row(seed * 10_000 + 100 * k + j, " ".join(
        rnd.choice(WORDS[lang]) + rnd.choice(["", "x", "na", "."]) for _ in range(length)), lang)
        for j, lang in enumerate(WORDS) for k in range(per_lang)]


def test_held_out_accuracy(spark):
    model = train(cases.frame(spark, rows(1, 30, 30)))
    found = identified(cases.frame(spark, rows(2, 20, 12)), model).collect()
    truth = {r[0]: r[2] for r in rows(2, 20, 12)}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in found)


def test_unknown_words_back_off_to_ngrams(spark):
    model = train(cases.frame(spark, rows(1, 30, 30)))
    assert model.words.rows.keys().isdisjoint({"pflichtzwerg", "kolomira"})
    assert model.predict("pflichtzwerg")[0] == "bb"
    assert model.predict("kolomira")[0] == "aa"
    assert model.predict("мир")[0] in WORDS


def test_und(spark):
    model = train(cases.frame(spark, rows(1, 5, 10)))
    found = identified(cases.frame(spark), model).collect()
    assert len(found) == len(cases.awkward())
    expected = {r[0]: not letters(r[1]) for r in cases.awkward() if r[0] is not None}
    for r in found:
        if r.doc_id is not None:
            assert (r.lang_pred == "und" and r.score == 0) == expected[r.doc_id]
    assert model.predict("123 !? 🙂") == ("und", 0.0)


def test_signs_are_no_letters(spark):
    model = train(cases.frame(spark, rows(1, 5, 10)))
    for text in ("²", "½ ⅓", "Ⅷ", "① 2³", "_²_", "٣"):
        assert model.predict(text) == ("und", 0.0), text
    assert model.predict("m²")[0] in WORDS


def test_a_rare_language_is_learned(spark):
    """Three rows of it beside thousands of another, few rows and few items allowed."""
    for seed in range(4):
        common = [cases.row(seed * 10_000 + k, f"bana kolo mira w{k % 900} v{k}", "aa")
                  for k in range(3000)]
        rare = [cases.row(90_000 + k, "strsch pflicht zwerg knopf", "bb") for k in range(3)]
        model = train(cases.frame(spark, common + rare), max_rows=50, max_items=40)
        assert model.langs == ["aa", "bb"]
        assert {"pflicht", "zwerg", "bana"} <= model.words.rows.keys()
        assert model.predict("zwerg knopf")[0] == "bb" and model.predict("kolo mira")[0] == "aa"
        assert len(model.words.rows) <= 2 * 40 and len(model.parts.rows) <= 2 * 40


def test_repeated_rows_of_one_language(spark):
    docs = [cases.row(None, "bana kolo", "aa")] * 500 + rows(1, 3, 5)
    assert train(cases.frame(spark, docs), max_rows=10).predict("façon mèche")[0] == "cc"


def test_label_of_a_row_is_no_input(spark):
    model = train(cases.frame(spark, rows(1, 5, 10)))
    df = cases.frame(spark, rows(2, 5, 10))
    other = df.selectExpr("*").drop("lang").selectExpr("*", "'zz' AS lang")
    assert sorted(map(tuple, identified(df, model).collect())) == \
        sorted(map(tuple, identified(other, model).collect()))


def test_empty_tables(spark):
    model = train(cases.frame(spark, []))
    assert model.predict("word") == ("und", 0.0)
    assert identified(cases.frame(spark, []), model).count() == 0
