"""One query per group against its check SQL; tests/check_oracle.py runs them all."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.registry import all_sql
from shelfrank.plans.queries import all_queries
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "clean_data", "prepare", "vendor_cpu_amazon", "vendor_gpu_incehesap", "vendor_cpu_mediamarkt", "vendor_ram_vatan", "vendor_screen_vatan",
    "csv_round_trip", "history_append", "new_listings_anti", "budget_filter", "usage_filter_portability", "usage_fallback_dev",
    "score_parts", "score_breakdown", "score_total_dev", "dev_fit_ml", "diverse_topn", "recommend_batch", "rec_summary", "budget_slider",
    "page_links", "page_specs", "page_listings_incehesap", "stream_append", "stream_dedup",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    problem, _, _, n = compare(spark, duck, SF, name, queries()[name], oracle_sql()[name])
    assert problem is None and n > 0


def test_every_check_has_a_query_and_back():
    assert set(all_queries()) == set(all_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
