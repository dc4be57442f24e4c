import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfrank.llm import spelling as S


def plain_words(rows, shortest, fewest, erased):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if erased and h % erased == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, shortest, fewest, ratio, erased):
    n = plain_words(rows, shortest, fewest, erased)
    form, count = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w], count[w] = (best if best is not None and n[best] >= ratio * n[w] else None), len(others)

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


def texts(seed, docs, letters="abéÀc"):
    """Words and their variants, some of them very frequent, so that forms follow each other."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 6, 9]))) for _ in range(30)]

    def one():
        w = base[int(30 * rng.random() ** 4)]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[: max(i - 1, 0)] + w[i:], w[: max(i - 1, 0)] + rng.choice(letters) + w[i:]])
        return w if rng.random() < 0.9 else w.upper()

    return [(i, " ".join(one() for _ in range(120)) + rng.choice(["", ".", "×y÷", "\n漢ab"])) for i in range(docs)]


@pytest.mark.parametrize("seed, cell, leaf", [(1, 4096, 24), (2, 8, 2), (3, 30, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, cell, leaf):
    """Small cells and boxes cut every tree deeply; results stay the same."""
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "PER_CELL", 1)
    monkeypatch.setattr(S, "LEAF", leaf)
    rows = texts(seed, 40) + [(None, "abcabc " * 30), (100, None), (101, ""), (7, "ABCabc" * 50 + " " + "x" * 3000), (7, "abcabd " * 9), (7, "abcabd " * 9)]
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = S.variants(docs, shortest=4, fewest=2, ratio=2, erased=7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows, 4, 2, 2, 7)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # forms that follow each other
    assert len(want) > 100


def test_long_words_and_equal_vectors(spark, monkeypatch):
    """Anagrams have one vector, so no box separates them; words of thousands of letters are compared whole."""
    monkeypatch.setattr(S, "LEAF", 2)
    monkeypatch.setattr(S, "COMPARED", 50)
    long = "ab" * 2000
    rng = random.Random(5)
    anagrams = ["".join(rng.sample("abcdefg", 7)) for _ in range(150)] + ["abcdefga", "abcdefg"]
    rows = [(1, " ".join(anagrams)), (2, f"{long} {long}x {long[:-1]}x {long[1:]}y {long} {long}"), (3, "ÿÿÿÿÿÿ ÿÿÿÿÿÀ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in S.variants(docs, fewest=1, ratio=2, erased=None).collect()), key=lambda r: r[0])
    assert got == plain(rows, 6, 1, 2, None)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    assert S.variants(docs).count() == 0
    assert S.variants(docs.limit(0)).count() == 0


def test_crc_of_many_ranges():
    data = np.frombuffer(random.Random(1).randbytes(4000), np.uint8)
    start, length = np.array([0, 5, 9, 100, 3]), np.array([0, 64, 1, 3000, 65])
    first = np.array([zlib.crc32(f"{i}:".encode()) for i in range(5)], np.uint32)
    got = S.crc32_from(first, data, start, length)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + data[s : s + n].tobytes()) for i, (s, n) in enumerate(zip(start, length))]
