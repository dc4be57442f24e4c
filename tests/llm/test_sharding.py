import hashlib
import math
import zlib

from shelfrank.llm import sharding as S

SCHEMA = "doc_id long, text string, size string, shard int"  # clashing extra columns


def brute(key, weights):
    def cost(shard, weight):
        return -math.log((int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    return min((cost(s, w), s) for s, w in weights.items() if w > 0)[1]


def test_rows_against_brute_force(spark):
    rows = [(i, None if i % 7 == 0 else "é" * i, "x", 9) for i in range(300)] + [(5, "again", "x", 9), (None, "no id", "x", 9)]
    got = S.shard_table(spark.createDataFrame(rows, SCHEMA), S.even(5), grown=S.even(6)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    slots = {}
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        assert (r["size"], r.text_crc32) in texts[r.doc_id]
        assert r.shard == brute(key, S.even(5)) and r.grown_shard == brute(key, S.even(6))
        assert r.grown_shard in (r.shard, 5)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights(spark):
    weights = {0: 1.0, 1: 3.0, 2: 0.0}
    rows = S.shard_table(spark.range(4000).selectExpr("id as doc_id", "'t' as text"), weights).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in rows}
    assert set(n) == {0, 1} and 2700 < n[1] < 3300


def test_many_runs_stay_gapless(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_RUN", 10)
    rows = S.shard_table(spark.range(500).selectExpr("id % 250 as doc_id", "'t' as text"), S.even(3)).collect()
    for shard in range(3):
        own = sorted(r.slot for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_empty_and_written(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.shard_table(empty, S.even(3)).count() == 0
    folder = S.write_shards(spark.range(100).selectExpr("id as doc_id", "'t' as text"), S.even(4))
    assert spark.read.parquet(folder).count() == 100
