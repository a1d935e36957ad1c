"""The pipeline stage by stage against plain Python, and the registered queries' columns."""

import cases
import corpus_pipeline

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(seen[name])
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == documents.columns
    good = seen["quality_rules"]
    sets = [(i, cases.shingle_set(r.text, 5)) for i, r in good.items()]
    found = cases.components(sets, 80)
    assert set(seen["ngram_jaccard_join"]) == {i for i in good if found[i] == i}
    cut = seen["substring_dedup"]
    assert set(cut) <= set(seen["ngram_jaccard_join"])
    runs = {}
    for i, r in cut.items():
        found_words = cases.words(r.text)
        for k in range(len(found_words) - 49):
            runs.setdefault(tuple(found_words[k:k + 50]), set()).add(i)
    assert sum(len(x) > 1 for x in runs.values()) <= len(runs) // 1000
    assert set(seen["source_mixing"]) == set(cut)
    assert all(r.text == cut[i].text for i, r in seen["source_mixing"].items())
    last = seen["sentence_pieces"]
    assert set(last) == set(cut) and all(r.ids for r in last.values())


def test_awkward_rows_and_empty_table(spark):
    for rows in (cases.awkward(), []):
        docs = cases.frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            assert set(docs.columns) <= set(found.columns)
            found.count()


def test_registered():
    names = driver.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
