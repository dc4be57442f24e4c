import random

import numpy as np

from shelfrank.llm import lang_id as L

STEMS = {"en": ["the", "thing", "and", "with", "lying", "ation"], "fr": ["les", "eaux", "où", "être", "ment", "que"], "de": ["der", "schön", "ung", "keit", "über", "ich"]}


def text(lang, n, draw):
    return " ".join("".join(draw.choice(STEMS[lang]) for _ in range(draw.randrange(1, 4))).capitalize() for _ in range(n)) + ", 12."


def rows(seed, n=300):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = draw.choice(list(STEMS))
        out.append((i, text(lang, draw.randrange(3, 60), draw), lang, 0.5, "x"))
    return out


SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def test_held_out_accuracy(spark):
    model = L.fit(spark.createDataFrame(rows(1), SCHEMA))
    test = rows(2)
    got = L.identify(spark.createDataFrame(test, SCHEMA), model)
    assert sorted(got.columns) == sorted(SCHEMA.replace(",", "").split()[::2])
    got = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99 and all(0 < r.score <= 1 for r in got)


def test_unknown_words_fall_back_to_shorter_and_shorter_grams(spark):
    model = L.fit(spark.createDataFrame([(1, "abcdef abcdef abcdef", "aa"), (2, "uvwxyz uvwxyz uvwxyz", "bb")], "doc_id long, text string, lang string"))
    cases = [(1, "xxabcdexx", "aa"), (2, "qqabqq", "aa"), (3, "qyq", "bb"), (4, "ABCDEF", "aa")]  # 5, 2, 1 known characters, a word
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(cases, "doc_id long, text string, want string"), model).collect()}
    assert got == {i: want for i, _, want in cases}


def test_odd_texts(spark):
    model = L.fit(spark.createDataFrame(rows(1), SCHEMA))
    odd = [(1, None), (2, ""), (3, " \n"), (4, "123 — ¿?"), (5, "the thing " * 30000), (6, "漢字"), (None, "les eaux"), (5, "les eaux")]
    got = [tuple(r)[0::1] for r in L.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()]
    by = {(r[0], (r[1] or "")[:9]): (r[2], r[3]) for r in got}
    assert len(got) == len(odd)
    assert all(by[i, (t or "")[:9]] == ("und", 0.0) for i, t in odd[:4])
    assert by[5, "the thing"][0] == "en" and by[None, "les eaux"][0] == "fr" and by[6, "漢字"][0] in STEMS
    kept = L.keep_known(spark.createDataFrame([(i, t, 1.0) for i, t in odd], "doc_id long, text string, score double"), model)
    assert kept.columns == ["doc_id", "text", "score"] and not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = L.fit(none)
    assert [tuple(r)[-2:] for r in L.identify(none, model).collect()] == [("und", 0.0)]
    assert L.identify(none.limit(0), L.fit(none.limit(0))).count() == 0


def test_sample_is_bounded(spark):
    some = L.fit_sample(spark.range(50_000).withColumnRenamed("id", "doc_id"), "doc_id", 1000)
    assert 800 < some.count() < 1200 and sorted(some.collect()) == sorted(some.collect())


def test_a_small_language_is_learned_beside_a_large_one(spark, monkeypatch):
    draw = random.Random(5)
    monkeypatch.setattr(L, "MAX_WORDS", 400)
    monkeypatch.setattr(L, "MAX_GRAMS", 200)
    syllables = {"aa": [a + b for a in "bcdfghjk" for b in "aeiou"], "bb": [a + b for a in "lmnpqrst" for b in "aeiou"]}
    make = lambda lang: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(12))
    train = [(i, make("aa"), "aa") for i in range(6000)] + [(10_000 + i, make("bb"), "bb") for i in range(6)]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), fit_rows=300)
    assert model.langs == ["aa", "bb"] and len(model.word) == 400
    assert ((model.word_value[:, 1] > model.word_value[:, 0]).sum()) > 50
    assert L.language_shares({"aa": 6000, "bb": 6}, 300) == {"bb": 1.0, "aa": 294 / 6000}
    got = L.identify(spark.createDataFrame([(i, make("bb")) for i in range(50)], "doc_id long, text string"), model)
    assert sum(r.lang_pred == "bb" for r in got.collect()) > 45
