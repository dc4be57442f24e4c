import hashlib
import random
import re

import pytest

from shelfrank.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            if item is None or body is None:
                continue
            w = words(body)
            n = min(10, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(own) - n + 1):
                    if own[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    draw = random.Random(3)
    vocabulary = ["The", "a", "éa", "Ö", "x1", "run", "runs", "ab", "c", "zz"]
    text = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ",", ".", " -"]) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(90, None), (None, "a a"), (91, ""), (92, "..."), (93, items[3][1]), (94, "unique words here only"), (95, "runs runs runs runs runs runs runs runs runs runs runs")]
    docs = [(i, text(draw.randrange(60))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, items[2][1]), (103, items[2][1]), (104, f"x {items[6][1]} y {items[6][1]}"), (105, "run " * 20000 + items[5][1]), (106, "runs " * 30), (None, items[7][1])]
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 400])
def test_against_brute_force(spark, block):
    docs, items = case()
    if block == 400:  # rows that are equal become one
        docs = [d for i, d in enumerate(docs) if d not in docs[:i]]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.decontaminate(rows, bench, block_bytes=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    kept = D.keep_uncontaminated(rows, bench, block_bytes=block)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(docs, items) if not r[5])


def test_empty_tables(spark):
    docs, items = case()
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.digest(D.decontaminate(rows.limit(0), bench)).count() == 0
    assert [r.n_hit for r in D.digest(D.decontaminate(rows, bench.limit(0))).collect()] == [0] * len(docs)


def test_runs_of_hit_words(spark):
    rows = spark.createDataFrame([(1, "x alpha beta y alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Alpha, beta")], "item_id long, text string")
    row = D.decontaminate(rows, bench).first()
    assert [tuple(r) for r in row.runs] == [(1, 2), (4, 5)] and list(row["items"]) == ["7"]


def test_repeated_rows_stay_with_several_blocks(spark):
    docs, items = case()
    rows = spark.createDataFrame(docs + [(None, docs[-1][1]), (None, None)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.decontaminate(rows, bench, block_bytes=400)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs + [(None, docs[-1][1]), (None, None)], items)


def test_runs_are_the_same_with_several_blocks(spark):
    docs, items = case()
    rows = spark.createDataFrame([d for i, d in enumerate(docs) if d not in docs[:i]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, several = ([(r.doc_id, r.n_words, list(map(tuple, r.runs)), list(r["items"])) for r in D.decontaminate(rows, bench, block_bytes=n).collect()] for n in (D.BLOCK_BYTES, 400))
    assert sorted(one, key=str) == sorted(several, key=str) and any(b > a for r in one for a, b in r[2])
