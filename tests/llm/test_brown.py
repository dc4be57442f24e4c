import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import brown as B


def corpus(n=120):
    draw = random.Random(4)
    nouns, verbs, ends = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(20)], ["now", "Here"]
    docs = [(i, " ".join(f"the {draw.choice(nouns)} {draw.choice(verbs)}" for _ in range(draw.randrange(1, 30))) + " " + draw.choice(ends) + f" rare{i // 2}") for i in range(n)]
    return docs + [(500, None), (501, ""), (502, " \n"), (503, "unseen words only"), (3, docs[3][1]), (None, "the n1 v1"), (504, "the n1 v2 " * 5000)]


def tokens(text):
    return [*(text or "").encode().lower().split(), b"</end>"]


@pytest.mark.parametrize("block", [B.BLOCK_BYTES, 300])
def test_base_scores_and_gain(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    docs = corpus()
    rows = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(3)
    got = B.score(rows, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))).collect()
    counts = Counter()
    for d, t in docs:
        if d is None or d % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d is not None, d or 0), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in docs)
    have = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert np.allclose([w[4] for w in want], [h[4] for h in have])
    held = [r for r in got if not r.train]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held) and all(r.score <= 1e-9 for r in got)


def test_a_history_gives_probabilities_that_add_up():
    draw = np.random.default_rng(0)
    follows = draw.integers(0, 50, (B.START + 1, B.END + 1)).astype(float)
    assert np.allclose((10 ** B.transitions(follows, draw.integers(0, 9, B.START + 1).astype(float))).sum(axis=1), 1)


def likelihood(bigrams, clas, total):
    hot = np.eye(total)[clas]
    table = hot.T @ bigrams @ hot
    return B._xlogx(table).sum() - B._xlogx(table.sum(0)).sum() - B._xlogx(table.sum(1)).sum()


def test_exchange_reaches_a_local_optimum_and_finds_the_classes():
    draw = np.random.default_rng(1)
    side = np.arange(24) % 3  # words of class c are followed by words of class c + 1
    bigrams = draw.integers(0, 3, (26, 26)).astype(float)
    bigrams[:24, :24] += 40 * (side[None, :] == (side[:, None] + 1) % 3)
    clas = B.exchange(bigrams, 3, fixed=2)
    assert len({(a, b) for a, b in zip(clas, side, strict=True)}) == 3
    whole = np.concatenate([clas, [3, 4]])
    best = likelihood(bigrams, whole, 5)
    for w in range(24):
        for c in range(3):
            other = whole.copy()
            other[w] = c
            assert likelihood(bigrams, other, 5) <= best + 1e-6


def test_history_skips_rare_words():
    block = B.Block(np.array([0, 2, 1, 2, 2, 0], np.int32), np.zeros(3, np.uint64), np.array([4, 0, 2]), np.array([True] * 3))
    clas = np.array([5, 6, B.UNSEEN])
    assert B.history(block, clas).tolist() == [B.START, 5, 5, 6, B.START, B.START, 6, B.START, 5]


def test_empty_and_untrained(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert B.score(rows.limit(0), F.lit(True)).count() == 0
    got = B.score(rows, F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(0, 0, 0.0)] * 2


def test_a_round_finds_each_words_best_class(monkeypatch):
    draw = np.random.default_rng(7)
    n = 40
    bigrams = draw.integers(0, 30, (n + 1, n + 1)) * (draw.random((n + 1, n + 1)) < 0.3).astype(float)  # the last is the edge of a text
    bigrams[n, n] = 0
    clas = np.concatenate([draw.integers(0, 6, n), [B.END]])
    clas[:5] = B.UNSEEN
    hot = np.eye(B.END + 1)[clas]
    table = hot.T @ bigrams @ hot
    got = B.reassign(clas[:n], (bigrams.T @ hot)[:n], (bigrams @ hot)[:n], np.diag(bigrams)[:n], table)
    for w in range(n):
        moved = np.repeat(clas[None], B.CLASSES, axis=0)
        moved[:, w] = np.arange(B.CLASSES)
        every = [likelihood(bigrams, m, B.END + 1) for m in moved]
        assert every[got[w]] > max(every) - 1e-6


def test_every_training_word_has_a_class_by_its_contexts_and_is_a_history(spark):
    draw = random.Random(9)
    pairs = [f"a{i} x z" for i in range(3000)] * 6 + [f"b{i} y z" for i in range(3000)] * 6  # far more words than VOCABULARY
    draw.shuffle(pairs)
    docs = [(i, " ".join(pairs[i * 50 : i * 50 + 50])) for i in range(720)]
    got = B.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 8 != 1).where(~F.col("train")).collect()
    best = 50 * math.log10(6000)  # a word of 6000, and what follows it is certain; 1024 words alone score worse by over 50
    assert len(got) == 90 and -sum(r.score for r in got) / 90 < best + 20


def test_words_used_once_are_worked_out_once(monkeypatch):
    draw = np.random.default_rng(5)
    table = draw.integers(0, 9, (B.END + 1, B.END + 1)).astype(float)
    clas, before, after = draw.integers(0, B.UNSEEN + 1, 400), draw.integers(0, B.END + 1, 400), draw.integers(0, B.END + 1, 400)
    table[before, clas] += 1
    table[clas, after] += 1
    one = np.eye(B.END + 1)
    want = B.reassign(clas, one[before], one[after], np.zeros(400), table)
    once = B.Once(table, B._steps(table))
    assert np.array_equal(once.classes(clas, before, after), want)
    monkeypatch.setattr(B, "reassign", None)
    assert np.array_equal(once.classes(clas[::-1], before[::-1], after[::-1]), want[::-1])


def test_small_ranges_are_taken_together(monkeypatch):
    rows = pa.RecordBatch.from_pylist([{"range": r, "words": b"x" * 8} for r in (1, 1, 2, 5, 5, 7)])
    of = lambda: [[r["range"] for r in g] for g in B._by_range([rows.slice(0, 4), rows.slice(4)])]
    assert of() == [[1, 1, 2, 5, 5, 7]]
    monkeypatch.setattr(B, "AT_ONCE", 3)
    assert of() == [[1, 1, 2], [5, 5, 7]]
    monkeypatch.setattr(B, "AT_ONCE", 1)
    assert of() == [[1, 1], [2], [5, 5], [7]]


def test_bigrams_travel_as_lists_of_cells(monkeypatch):
    monkeypatch.setattr(B, "CELLS", 4)
    total = np.array([0, 3, 0, 1 << 40, 0, 0, 0, 0, 7])
    rows = B._pack(total).to_pylist()
    assert [r["part"] for r in rows] == [0, 2]
    assert [B.unplanes(r["cells"], np.int32).tolist() for r in rows] == [[1, 3], [8]]
    assert [B.unplanes(r["n"], np.int64).tolist() for r in rows] == [[3, 1 << 40], [7]]
    assert B._pack(total * 0).num_rows == 0


def test_bigrams_of_training_texts():
    text = [0, 1, 0, 2, 1, 1]  # words 0 and 1 are frequent, 2 isn't; the text in the middle is no training text
    block = B.Block(np.array(text), np.arange(3, dtype=np.uint64), np.array([2, 2, 0, 2]), np.array([True, False, True, True]))
    bigrams = B.Bigrams(2)
    bigrams.add(block, np.array([0, 0, 5]), np.array([1, 3, 0]), np.array([0, 1, -1]))
    end, side = 2 + B.END, bigrams.side
    want = Counter([(end, 0), (0, 1), (1, end), (end, end), (end, 1), (1, 1), (1, end)])
    assert {divmod(int(c), side): int(bigrams.total[c]) for c in np.flatnonzero(bigrams.total[: side * side])} == want
    assert np.flatnonzero(bigrams.total[side * side :]).tolist() == [end]


def test_distinct_hashes_in_order():
    draw = np.random.default_rng(3)
    for hashes in (draw.integers(0, 1 << 64, 500, dtype=np.uint64)[draw.integers(0, 500, 3000)], np.zeros(0, np.uint64)):
        want, places = np.unique(hashes, return_inverse=True)
        known, which = B.distinct(hashes)
        assert np.array_equal(known, want) and np.array_equal(which, places) and known.dtype == np.uint64
