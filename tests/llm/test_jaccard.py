import random
from itertools import combinations

import numpy as np
import pytest

from shelfrank.llm import jaccard as J
from shelfrank.llm import signature_tree as S


def sets_of(docs, size):
    out = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute(docs, size, percent):
    sets = sets_of(docs, size)
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, size=3):
    """Bases of many lengths with chains of ever more changed copies, and a passage that many share."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghijklmnop") + str(draw.randrange(60))
    passage = [word() for _ in range(40)]
    texts = []
    for n in [1, 2, 3, 5, 8, 12, 20, 35, 60, 90, 99, 100, 101, 105, 112, 130, 150, 160, 240, 400]:
        own = [word() for _ in range(n)]
        if n % 4 == 0:
            own[n // 2 : n // 2] = passage
        for _ in range(12):
            texts.append(" ".join(own))
            own = list(own)
            for _ in range(draw.randrange(1, 2 + len(own) // 60)):
                at = draw.randrange(len(own))
                own[at : at + draw.choice([0, 1, 1])] = [word()] * draw.choice([0, 1, 1])
                own = own or [word()]
    draw.shuffle(texts)
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return docs + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, docs[0][1].upper()), (2004, "tiny"), (2005, "Tiny"), (2006, "long " * 9000)]


@pytest.mark.parametrize(("size", "percent", "small_blocks"), [(3, 90, False), (5, 80, True), (3, 60, False)])
def test_against_brute_force(spark, monkeypatch, size, percent, small_blocks):
    if small_blocks:  # several blocks a group, several packs a task
        monkeypatch.setattr(J, "BLOCK_SETS", 3)
        monkeypatch.setattr(J, "PACK", 500)
        monkeypatch.setattr(J, "KEY_SETS", 3)
        monkeypatch.setattr(J, "FEW", 2)
    docs = corpus(percent)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, component_id string, u int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.groups(rows, size, percent).collect()}
    assert got == brute(docs, size, percent)


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    docs = corpus(5)
    monkeypatch.setattr(J, "FREQUENT", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()}
    assert got == brute(docs, 3, 80)


def test_repeated_and_missing_ids(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(3, body), (3, body), (1, body + " x"), (None, body), (5, "other words here"), (5, body), (6, "other words here")]
    got = sorted(((r.doc_id, r.component_id) for r in J.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert [c for d, c in got if d == 3] == [1, 1] and [c for d, c in got if d == 1] == [1] and (None, None) in got
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert [d for d, _ in map(tuple, kept.collect())].count(1) == 1 and None in [r.doc_id for r in kept.collect()]


def test_one_row_of_each_group_of_texts_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (0, a), (2, c), (None, c), (None, b + " x"), (None, a[::-1]), (None, a[::-1]), (5, None), (5, " "), (5, None), (6, "one two"), (7, "one two")]
    got = J.keep_one(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, own0 string, component_id int").repartition(3), 5, 80)
    assert got.columns == ["doc_id", "text", "own0", "component_id"]
    want = [(0, a), (1, b), (2, c), (None, c), (None, b + " x"), (None, a[::-1]), (None, a[::-1]), (5, None), (5, None), (5, " "), (6, "one two")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.groups(empty).count() == 0 and J.keep_one(empty).count() == 0


@pytest.mark.parametrize("split", [None, 150])
def test_tree_finds_all_ties(split):
    draw = np.random.default_rng(2)
    base = [draw.integers(0, 1 << 60, n) for n in (30, 200, 210, 215, 500)]
    sets = []
    for _ in range(300):
        b = base[draw.integers(len(base))]
        own = b[draw.random(len(b)) < draw.choice([0.9, 0.95, 0.97])]
        sets.append(np.unique(np.concatenate([own, draw.integers(0, 1 << 60, draw.integers(0, 4))])).astype(np.uint64))
    found = S.links(S.Sets(np.concatenate(sets), np.array([len(s) for s in sets])), 85, split)
    pure = [frozenset(s.tolist()) for s in sets]
    linked = lambda a, b: 100 * len(pure[a] & pure[b]) >= 85 * len(pure[a] | pure[b])
    assert found and all(linked(a, b) for a, b in found)

    def labels(edges):
        head = list(range(300))
        for a, b in edges:
            x, y = head[a], head[b]
            head = [min(x, y) if h in (x, y) else h for h in head]
        return head

    every = [(a, b) for a, b in combinations(range(300), 2) if linked(a, b)]
    if split is None:
        assert labels(found) == labels(every)
    else:  # with the links within both blocks, which other tasks find
        inside = [(a, b) for a, b in every if (a < split) == (b < split)]
        assert labels(found + inside) == labels(every)


def test_linked_sets_share_a_key_though_the_parts_they_share_are_empty():
    """A base of frequent shingles only, and copies whose own shingles fill all parts but a few."""
    draw, router, links = np.random.default_rng(3), J.Router(90), 0
    for _ in range(300):
        base = np.unique(draw.integers(0, 1 << 62, 100, dtype=np.uint64)) | J._HOT
        own = np.sort(draw.integers(0, 1 << 50, 11, dtype=np.uint64) * router.parts[0].astype(np.uint64) + np.arange(11, dtype=np.uint64))  # a part each
        copy = np.concatenate([own, base])  # frequent ones last
        links += 100 * len(base) >= 90 * len(copy)
        keys, owner = router.keys(np.concatenate([base, copy]), np.array([len(base), len(copy)]))
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert links == 300


def test_sketches_never_turn_down_a_link_and_tell_unlike_sets_apart():
    draw, sets = np.random.default_rng(4), []
    for n in (1, 5, 40, 130, 260, 520, 3000):
        base = draw.integers(0, 1 << 62, n, dtype=np.uint64)
        for keep in (1, 0.99, 0.95, 0.9, 0.5):
            sets.append(np.unique(np.concatenate([base[draw.random(n) < keep], draw.integers(0, 1 << 62, n // 50, dtype=np.uint64)])))
    sets = [x for x in sets if len(x)]
    size = np.array([len(x) for x in sets])
    sketch, words = J.sketches(np.concatenate(sets), size)
    one, two = (np.array(x) for x in zip(*combinations(range(len(sets)), 2), strict=True))
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(one, two, strict=True)])
    linked = 180 * both >= 80 * (size[one] + size[two])
    may = J.Meeting(size, sketch, words, 80).may(one, two)
    assert linked.any() and may[linked].all()
    unlike = (both < 0.6 * np.minimum(size[one], size[two])) & (np.minimum(size[one], size[two]) > 100)
    assert unlike.any() and not may[unlike].any()


@pytest.mark.parametrize("few", [1, 24])
def test_ties_hang_together_what_pairs_do(monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    draw, sets, start, length = np.random.default_rng(6), [], [], []
    for m in (2, 3, 7, 20):
        start.append(len(sets))
        length.append(m)
        bases = [draw.integers(0, 1 << 62, 200, dtype=np.uint64) for _ in range(2)]
        sets += [bases[i % 2][draw.random(200) < 0.97] for i in range(m)]
    size = np.array([len(x) for x in sets])
    meeting = J.Meeting(size, *J.sketches(np.concatenate(sets), size), 80)
    u, v = meeting.ties(np.array(start), np.array(length))
    head = list(range(len(sets)))
    for a, b in zip(u, v, strict=True):
        x, y = head[a], head[b]
        head = [min(x, y) if h in (x, y) else h for h in head]
    want = [s + i % 2 for s, m in zip(start, length, strict=True) for i in range(m)]
    assert head == want


def test_sets_that_share_a_passage_are_no_group(spark):
    """Unlike texts around one passage: their keys meet, and sketches tell them apart."""
    draw = random.Random(9)
    own = lambda n: " ".join(f"v{draw.randrange(10**6)}" for _ in range(n))
    passage = own(150)
    rows = [(i, f"{own(70)} {passage} {own(70)}") for i in range(60)]
    sets, found = J.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sets.count() == 60 and found.count() == 0
