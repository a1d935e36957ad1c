import math
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from paylens.llm import character_model
from paylens.llm.perplexity import (
    ORDER, _codes, _dense, _discounts, classified, counted, model_tables, scored,
)
from paylens.llm.scratch import Scratch


def kneser_ney(texts, discounts):
    """P(gram) by the textbook recursion, from dictionaries."""
    grams = Counter()
    for text in texts:
        codes = _codes([text])[0].tolist()
        grams.update(tuple(c >> 6 * (ORDER - 1 - k) & 63 for k in range(ORDER)) for c in codes)
    levels = [None] * (ORDER + 1)
    levels[ORDER] = grams
    for order in range(ORDER - 1, 0, -1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / 64
        held, d = levels[order], discounts[order - 1]
        around = [n for g, n in held.items() if g[:-1] == gram[:-1]]
        if not around:
            return p(gram[1:])
        cut = [d[min(n, 3) - 1] for n in around]
        n = held.get(gram, 0)
        own = (n - d[min(n, 3) - 1]) / sum(around) if n else 0
        return own + sum(cut) / sum(around) * p(gram[1:])

    return p, levels


def test_model_equals_the_textbook(spark):
    texts = [cases.prose(k, 30) for k in range(6)] + ["Zwölf. Boxkämpfer!", "", "ab"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    scratch = Scratch(spark, "test")
    top = scratch.save(counted(df), "top")
    tables = model_tables(top, scratch)
    held = []
    for grams, contexts in tables:
        a, b = grams.toArrow(), contexts.toArrow()
        held.append((a.column(0).to_numpy(), a.column(1).to_numpy(), b.column(0).to_numpy(),
                     b.column(1).to_numpy()))
    dense = _dense(held)
    levels = [top]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, levels[0].selectExpr(f"gram & {(1 << 6 * order) - 1} AS gram")
                      .groupBy("gram").count().withColumnRenamed("count", "n"))
    p, _ = kneser_ney(texts, [_discounts(x) for x in levels])
    probe = _codes([texts[0][:20], "xyz#*! Qq 12", texts[6]])[0].tolist()
    for code in probe:
        gram = tuple(code >> 6 * (ORDER - 1 - k) & 63 for k in range(ORDER))
        assert dense[code] == pytest.approx(math.log(p(gram)), abs=1e-4)
    # Whatever the context, the classes' probabilities add up to one.
    assert np.exp(dense.reshape(-1, 64).astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-3)


def test_perplexity_of_a_text(spark):
    df = spark.createDataFrame([(cases.prose(1, 50),)], "text string")
    scratch = Scratch(spark, "test")
    tables = model_tables(scratch.save(counted(df), "top"), scratch)
    docs = cases.frame(spark)
    found = scored(docs, tables).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r.perplexity for r in found}
    assert by_id[1] is None and by_id[2] is None
    assert all(v is None or 1 <= v for v in by_id.values())


def test_clean_stays_and_noise_goes(spark):
    rows = [cases.row(k, cases.prose(k, 60), "en" if k % 2 else "de") for k in range(120)]
    noise = [cases.row(1000 + k, " ".join(f"{w.upper()}!!&" for w in cases.prose(k, 60).split()))
             for k in range(20)]
    docs = cases.frame(spark, rows + noise + [cases.row(5000, None), cases.row(5001, "")])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60)] + [(1000, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in classified(docs, labels).collect():
        got[r.kept].append(r.doc_id)
    assert sorted(got[True]) == list(range(120))
    assert sorted(got[False]) == [*range(1000, 1020), 5000, 5001]


def test_no_trusted_text_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark)
    found = classified(docs, labels)
    assert found.count() == docs.count()
    assert found.where("perplexity IS NOT NULL AND NOT kept").count() == 0
    assert classified(cases.frame(spark, []), labels).count() == 0


GREEK = "τα παιδια παιζουν στον κηπο και η μητερα τους μαγειρευει στην κουζινα για το βραδυ"
CYRILLIC = "дети играют в саду а мама готовит на кухне ужин для всей большой семьи и гостей"
HAN = "孩子们在花园里玩耍妈妈在厨房里做饭今天晚上有客人来家里吃饭大家都很高兴"


@pytest.mark.parametrize("base", [GREEK, CYRILLIC, HAN])
def test_scrambled_letters_of_any_script_go(spark, base):
    rnd = np.random.default_rng(5)
    units = base.split() if " " in base else [base[k:k + 3] for k in range(0, len(base), 3)]
    joint = " " if " " in base else ""
    texts = [joint.join(rnd.choice(units, 80)) for _ in range(90)]
    letters = [c for c in base if c != " "]
    bad = ["".join(c if c == " " else rnd.choice(letters) for c in t) for t in texts[:15]]
    docs = cases.frame(spark, [cases.row(k, t, "xx") for k, t in enumerate(texts)]
                       + [cases.row(1000 + k, t, "xx") for k, t in enumerate(bad)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)],
                                   "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in classified(docs, labels).collect()}
    assert all(r.kept for k, r in found.items() if k < 1000)
    assert not any(r.kept for k, r in found.items() if k >= 1000)


def brute_perplexities(trusted, texts):
    """Interpolated modified Kneser-Ney from dictionaries of strings."""
    pad = "\U0010ffff" * 3
    levels = [Counter((pad + t)[i:i + 4] for t in trusted for i in range(len(t)))]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts = []
    for held in levels:
        n1, n2, n3, n4 = (sum(n == k for n in held.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] \
            if n1 and n2 and n3 else [0.5, 0.75, 0.9]
        discounts.append([min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1)]
                         if n1 and n2 and n3 else found)
    around = [defaultdict(list) for _ in levels]
    for held, by in zip(levels, around):
        for g, n in held.items():
            by[g[:-1]].append(n)

    def p(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        k = len(gram) - 1
        total = sum(around[k].get(gram[:-1], []))
        if not total:
            return p(gram[1:])
        d, n = discounts[k], levels[k].get(gram, 0)
        own = n - d[min(n, 3) - 1] if n else 0
        return (own + sum(d[min(x, 3) - 1] for x in around[k][gram[:-1]]) * p(gram[1:])) / total

    return [math.exp(-sum(math.log(p((pad + t)[i:i + 4])) for i in range(len(t))) / len(t))
            for t in texts]


def test_perplexities_equal_the_textbook(spark, monkeypatch):
    monkeypatch.setattr(character_model, "CHUNK_ROWS", 3)
    trusted = [cases.prose(k, 30) for k in range(6)] + [GREEK, HAN, "😀 ok"]
    other = [cases.prose(9, 40), GREEK[::-1], "zzz \U0001f600", "a", "\x00￿"]
    docs = cases.frame(spark, [cases.row(k, t) for k, t in enumerate(trusted + other)]
                       + [cases.row(None, other[0]), cases.row(500, None), cases.row(501, "")])
    ids = spark.createDataFrame([(k,) for k in range(len(trusted))], "doc_id long")
    found = {r.doc_id: r.perplexity for r in character_model.perplexities(
        docs, ids, Scratch(spark, "test")).collect()}
    expected = brute_perplexities(trusted, trusted + other)
    assert found.pop(500) is None and found.pop(501) is None
    assert found.pop(None) == pytest.approx(expected[len(trusted)])
    assert [found[k] for k in range(len(expected))] == pytest.approx(expected)
