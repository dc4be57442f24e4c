import random

import pytest
from pyspark.sql import functions as F
from tests.test_recommend import SF, greedy, rows

from shelfrank.functions.scoring import add_features
from shelfrank.operators.ranking import brand_heads, diverse_top_of_heads
from shelfrank.plans import recommend as R
from shelfrank.plans.prepare import prepare
from shelfrank.sources import driver_tables as D
from shelfrank.sources import listing_store as LS
from shelfrank.sources.snapshot import publish, published, stored


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    """Offers of which some have no url, and some one common url."""
    path = str(tmp_path_factory.mktemp("features") / "t")
    url = F.when(F.col("seq") % 11 == 0, F.lit("https://shop.example/one")).when(F.col("seq") % 13 != 0, F.col("url"))
    add_features(prepare(D.listings(spark, SF).withColumn("url", url))).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def profiles(spark):
    return D.profiles(spark, SF).where("split(profile_id, '-')[0] = '3'")


@pytest.fixture(scope="module")
def store(spark, listings, tmp_path_factory):
    before, LS.FREQUENT_URL = LS.FREQUENT_URL, 50
    root = str(tmp_path_factory.mktemp("store"))
    yield LS.listing_store(spark, root, "listings", [("a", "1000", "t")], lambda: listings)
    LS.FREQUENT_URL = before


def test_store_gives_the_rows_of_plain_listings(store, listings, profiles):
    want = rows(R.recommend(listings, profiles))
    assert want and rows(R.recommend(store, profiles)) == want
    keep = rows(R.recommend(listings, profiles, null_urls="keep"))
    assert rows(R.recommend(store, profiles, null_urls="keep")) == keep


def test_buckets_take_the_place_of_a_shuffle_by_url(spark, store, profiles, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_RESULTS", 0)
    plan = R.recommend(store, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "REPARTITION_BY_COL" not in plan
    # Only pairs of offers that share a url or name are shuffled by it, once in each of the two passes of this plan.
    by_key = [line for line in plan.splitlines() if "Exchange hashpartitioning(url_key" in line]
    assert all("pno" in line for line in by_key) and len(by_key) == 2 and plan.count("Window [row_number() windowspecdefinition(url_key") == 4
    listing_scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "url_key" in line]
    assert listing_scans and all("(price" in line for line in listing_scans)


def test_one_url_or_none_fills_no_bucket(store):
    busiest = store.listings.groupBy("url_key").count().agg(F.max("count")).first()[0]
    assert busiest <= LS.FREQUENT_URL
    assert store.listings.where("url is null").count() > 50 and store.listings.where("url = 'https://shop.example/one'").count() > 50


def test_running_counts(store, listings):
    total = listings.where("price is not null").count()
    assert store.cells.agg(F.sum("n")).first()[0] == total
    for step in (1, 4, 9, LS.LAST_STEP):
        want = listings.where(F.col("price") < step * LS.PRICE_STEP).count()
        assert (store.running.where(F.col("_step") == step).agg(F.sum("n")).first()[0] or 0) == want
        cells = store.running.where(F.col("_step") == step)
        assert cells.count() == cells.select(*LS.COUNT_COLUMNS).distinct().count()


def test_counts_against_a_scan(store, listings, profiles):
    load_rows, load = R.store_profiles(profiles)
    got = {r.pno: (r.n_in, r.n_thin) for r in R.count_rows(store.cells, store.running, R.add_profile_constants(load_rows).select(*R.FILTER_COLUMNS), load).collect()}
    pairs = R.match_profiles(listings.select("price", *LS.COUNT_COLUMNS), R.add_profile_constants(load_rows).select(*R.FILTER_COLUMNS), R.filters.facets(), load)
    want = {r.pno: (r.n, r.thin) for r in pairs.groupBy("pno").agg(F.count("*").alias("n"), F.count(F.when(F.col("screen_size") <= 14.5, 1)).alias("thin")).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want


def test_no_listing_is_read_for_counts(store, profiles):
    table, load = R.store_profiles(profiles)
    plan = R.count_rows(store.cells, store.running, R.add_profile_constants(table).select(*R.FILTER_COLUMNS), load)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("url_key" not in line and "PartitionFilters: [_step" in line and " IN (" in line for line in scans)


def test_pairs_are_made_once(store, profiles, monkeypatch):
    """Unless few rows of each brand leave a profile open; then its pairs are made again, with the same result."""
    made, real = [], R.candidates
    monkeypatch.setattr(R, "candidates", lambda *a, **k: made.append(1) or real(*a, **k))
    want = rows(R.recommend(store, profiles))
    assert len(made) == 1
    monkeypatch.setattr(R, "HEAD_ROWS", 1)
    monkeypatch.setattr(R, "HEAD_FACTOR", 1)
    assert rows(R.recommend(store, profiles)) == want


def test_heads_settle_a_profile_or_leave_it_open(spark):
    rng = random.Random(9)
    cases = {f"r{i}": ("".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 40))), rng.randint(0, 4)) for i in range(200)}
    cases["open"] = ("a" * 9 + "b" + "a" * 9, 4)
    data = [(p, b, 100.0 - i // 3, i % 3, i, n) for p, (brands, n) in cases.items() for i, b in enumerate(brands)]
    df = spark.createDataFrame(data, "pno string, brand string, score double, price int, seq int, top_n int").repartition(4)
    got, is_open = {}, {}
    for r in diverse_top_of_heads(brand_heads(df, 4), 4).collect():
        got.setdefault(r.pno, []).append((r["rank"], r.seq))
        is_open[r.pno] = r["open"]
    settled = [p for p in cases if not is_open[p]]
    for p in settled:
        assert sorted(got[p]) == [(k + 1, i) for k, i in enumerate(greedy(*cases[p]))], cases[p]
    assert is_open["open"] and len(settled) > 120 and len(settled) < len(cases) - 3


def test_a_killed_writer_leaves_nothing_that_is_read(spark, tmp_path):
    base = f"{tmp_path}/t-key"

    def dies(folder):
        spark.range(5).write.parquet(f"{folder}/table")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish(spark, base, dies)
    assert published(spark, base) is None
    spark.createDataFrame([('{"table": "half',)], "value string").write.text(f"{base}/manifest-0")
    assert published(spark, base) is None

    def writes(folder):
        spark.range(7).write.parquet(f"{folder}/table")
        return {"table": f"{folder}/table"}

    found = publish(spark, base, writes)
    assert spark.read.parquet(found["table"]).count() == 7 and publish(spark, base, writes) == published(spark, base)


def test_stored_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stored(spark, str(tmp_path), "t", [("a", "1", "2")], build).count() == 3
    assert len(built) == 1
    assert stored(spark, str(tmp_path), "t", [("a", "1", "3")], build).count() == 3 and len(built) == 2
    assert stored(spark, str(tmp_path), "none", [], lambda: None) is None


