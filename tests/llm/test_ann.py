import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score string, cell string"


def exact(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def run(spark, rows, k, every=1):
    index = A.Index(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = {}
    for r in index.search(index.rows.where(F.col("vec_id") % every == 0), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def rows_of(ids, x):
    return [(int(i), [float(v) for v in r], "x", "y") for i, r in zip(ids, x, strict=True)]


@pytest.mark.parametrize("cells", [8192, 100])
def test_recall(spark, monkeypatch, cells):
    monkeypatch.setattr(A, "CELL_ROWS", cells)
    monkeypatch.setattr(A, "LEAF_ROWS", 32)
    monkeypatch.setattr(A, "QUERIES_AT_ONCE", 10)
    draw = np.random.default_rng(0)
    x = (draw.standard_normal((1500, 32)) + 2 * draw.standard_normal((12, 32))[draw.integers(0, 12, 1500)]).astype(np.float32) * draw.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    ids = draw.permutation(1500)
    got = run(spark, rows_of(ids, x), 20, every=20)
    wide, hit = x.astype(float), []
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact(ids, wide, q, 20)
        hit.append(len({i for i, _ in want} & {i for i, _ in got[ids[q]]}) / 20)
        score = {int(i): float(s) for i, s in zip(ids, (wide * wide[q]).sum(axis=1), strict=True)}
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[ids[q]])
        assert got[ids[q]] == sorted(got[ids[q]], key=lambda r: (-r[1], r[0]))
    assert len(hit) == 75 and np.mean(hit) >= 0.9


def test_ties_copies_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_ROWS", 40)
    x = np.tile(np.array([[1.0, 2.0, 3.0]], np.float32), (200, 1))  # all equal: smaller ids win
    rows = rows_of(np.arange(200), x)
    nan = float("nan")
    rows += [(900, None, "", ""), (901, [0.0, 0.0, 0.0], "", ""), (902, [1.0, None, 1.0], "", ""), (903, [1.0, nan, 1.0], "", ""), (904, [1.0, float("inf"), 1.0], "", ""), (905, [1.0], "", ""), (906, [], "", ""), (None, [9.0, 9.0, 9.0], "", "")]
    got = run(spark, rows, 5, every=50)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4]}
    assert all(s == 14.0 for r in got.values() for _, s in r)


def test_few_and_no_candidates(spark):
    assert run(spark, rows_of([1, 2, 3], np.eye(3) + 1), 20)[1] == [(2, 5.0), (3, 5.0)]
    assert run(spark, rows_of([4], np.ones((1, 3))), 20) == {}
    assert run(spark, [], 20) == {} and run(spark, [(1, None, "", "")], 20) == {}
    twice = rows_of([1, 1, 2], np.array([[1, 0, 1], [1, 0, 1], [2, 1, 0]]))  # a repeated row is one query, two candidates
    assert run(spark, twice, 5) == {1: [(2, 2.0)], 2: [(1, 2.0), (1, 2.0)]}


def test_quantile():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(A.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


@pytest.mark.parametrize("cells", [8192, 100])
def test_many_equal_vectors_and_one_hot_vectors(spark, monkeypatch, cells):
    monkeypatch.setattr(A, "CELL_ROWS", cells)
    draw = np.random.default_rng(1)
    for x in (np.tile(np.array([[0.1, 0.7, 0.3]], np.float32), (1000, 1)), np.eye(3, dtype=np.float32)[np.arange(1000) % 3]):
        ids = draw.permutation(1000)
        got = run(spark, rows_of(ids, x), 20, every=100)
        wide = x.astype(float)
        assert got == {int(ids[q]): [(i, pytest.approx(s)) for i, s in exact(ids, wide, q, 20)] for q in np.flatnonzero(ids % 100 == 0)}
