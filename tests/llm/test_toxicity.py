import random
from itertools import pairwise

import numpy as np

from shelfrank.llm import toxicity as T
from shelfrank.llm import words as W

WORDS = [f"w{i}" for i in range(400)]
BAD = ["vile", "scum", "grubby"]
SCHEMA = "doc_id long, text string, score string, predicted string"


def corpus(seed, n=1500):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = [draw.choice(WORDS) for _ in range(draw.randrange(5, 150))]
        bad = i % 8 == 0
        if bad:
            for _ in range(3 + len(own) // 40):
                own.insert(draw.randrange(len(own)), draw.choice(BAD) + draw.choice(["", "", "ness", "ly"]))
        docs.append((i, " ".join(own), "x", "y"))
        labels.append((i, int(bad), "other"))
    return docs, labels


def fitted(spark):
    docs, labels = corpus(1)
    return T.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, text string"))


def test_held_out_accuracy_and_odd_texts(spark):
    model = fitted(spark)
    docs, labels = corpus(2, 400)
    odd = [(1000, None, "x", "y"), (1001, "", "x", "y"), (1002, "?!", "x", "y"), (1003, "w1 " * 50000, "x", "y"), (None, "w1 w2", "x", "y"), (7, docs[7][1], "x", "y")]
    rows = spark.createDataFrame(docs + odd, SCHEMA)
    got = T.score(rows, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "passages"]
    got = got.collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    said = {r.doc_id: r.predicted for r in got}
    hits = [said[i] for i, bad, _ in labels if bad]
    assert np.mean(hits) > 0.9 and sum(said[i] for i, bad, _ in labels if not bad) <= 4
    assert not any(said[i] for i in (1000, 1001, 1002, 1003, None))
    kept = T.keep_clean(rows, model)
    assert kept.columns == rows.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_passages_hold_the_bad_words(spark):
    model = fitted(spark)
    text = " ".join(WORDS[:60]) + " vile scum w7 grubby " + " ".join(WORDS[60:120])
    row = T.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(p["first"], p["last"]) for p in row.passages] == [(60, 63)]


def test_labels(spark):
    docs, labels = corpus(1, 200)
    rows = spark.createDataFrame(docs, SCHEMA)
    for none in ([], [(i, 1) for i in range(50)], [(None, 1), (3, None)]):
        model = T.fit(rows, spark.createDataFrame(none, "doc_id long, toxic int"))
        assert all(r.score < 0.01 and r.predicted == 0 for r in T.score(rows, model).collect())
    assert T.score(rows.limit(0), fitted(spark)).count() == 0


def test_segments_against_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(200):
        score = draw.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 1.5, 3.0], draw.integers(1, 25))
        total = np.cumsum(score)
        good = np.flatnonzero(score > 0)
        got = [(a, b) for a, b, _ in T.segments(good, score[good], total[good])]

        def best(low, high):  # all maximal segments: the best one, then those left and right of it
            found = [(score[a : b + 1].sum(), -(b - a), -a, a, b) for a in range(low, high) for b in range(a, high)]
            found = [f for f in found if f[0] > 0]
            if not found:
                return []
            *_, a, b = max(found)
            return best(low, a) + [(a, b)] + best(b + 1, high)

        want = best(0, len(score))
        assert sum(score[a : b + 1].sum() for a, b in got) == sum(score[a : b + 1].sum() for a, b in want)
        assert max([score[a : b + 1].sum() for a, b in got], default=0) == max([score[a : b + 1].sum() for a, b in want], default=0)
        assert all(x[1] < y[0] for x, y in pairwise(got))


def test_more_passages_are_more_evidence():
    one, two = (T.evidence(np.array(s), 300, 1.0, 0.1) for s in ([8.0], [8.0, 8.0]))
    assert two > one > T.evidence(np.array([8.0]), 30000, 1.0, 0.1) and T.evidence(np.zeros(0), 10, 1.0, 0.1) == 0


def test_words_are_found_by_bytes():
    import pyarrow as pa

    texts = ["a b", "", None, "\n", "É b", "x" * 70000, "a-b c"]
    found = [(at + int(t), w.word(i)) for at, _, w in W.pieces(pa.array(texts), limit=5) for i, t in enumerate(w.text)]
    assert found == [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().lower().split()]
