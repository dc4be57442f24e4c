"""No task's share grows with the input."""

import pytest
from pyspark.sql import functions as F
from tests.test_streaming import HEADER

from shelfrank.functions import amazon, incehesap, vatan
from shelfrank.functions.text import folded, group
from shelfrank.sources import driver_tables as D
from shelfrank.sources import history as H
from shelfrank.sources import listing_store as LS
from shelfrank.sources.html import parse
from shelfrank.streaming import history_stream as HS


def orders(spark, folder, n):
    """A table in one row group."""
    rows = spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "DATE'1997-01-01' AS o_orderdate", "CAST(id AS DOUBLE) AS o_totalprice")
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_one_row_group_is_dealt_out_by_its_size(spark, tmp_path, monkeypatch):
    folder = orders(spark, tmp_path, 4000)
    monkeypatch.setattr(D, "PIECE_BYTES", D.stored_bytes(spark, f"{folder}/orders.parquet") // 40)
    made = D.sql_over(spark, folder, D.MADE_PAGES["detail_all"])
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 40 and max(sizes) <= 200


def test_many_empty_pieces_are_not_taken_for_spread_rows(spark, monkeypatch):
    rows = spark.range(4000).coalesce(1).unionByName(spark.range(0).repartition(64))
    dealt = D.spread(rows, 0)
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) <= 4000 / 8 * 1.5


def test_buckets_grow_with_the_input():
    assert [LS.bucket_count([("a", str(n << 20), "t")]) for n in (0, 1, 60, 970)] == [8, 8, 60, 970]


@pytest.fixture
def no_small_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_of_the_history_is_read_by_many_tasks(spark, tmp_path, no_small_tables):
    table = str(tmp_path / "history")
    rows = spark.createDataFrame([("u1", "amazon"), ("u2", "vatan")], "url string, source string")
    for _ in range(2):
        HS._add(rows, table, HS.run_id("state"), 0)
    read = H.read(spark, table)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and read.count() == 2


def test_the_lines_of_a_file_are_not_gathered(spark, tmp_path, no_small_tables, monkeypatch):
    folder, plans = tmp_path / "in", []
    folder.mkdir()
    (folder / "amazon_laptops.csv").write_text(HEADER + "u1,a,1,,,,,,\nu2,b,2,,,,,,\n")
    (folder / "vatan_laptops.csv").write_text("Fiyat;urun;url\n2;b;u2\n\n3;c;u3\n")
    monkeypatch.setattr(HS, "_add", lambda rows, *_: plans.append((rows._jdf.queryExecution().executedPlan().toString(), rows.count())))
    HS.append_files(spark, str(folder), str(tmp_path / "history"), str(tmp_path / "state")).awaitTermination()
    (plan, n), = plans
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and n == 4


def test_a_pattern_in_a_branch_is_matched_once(spark):
    df = spark.createDataFrame([("rtx 4060",), ("none",), (None,)], "t string")
    found = df.select(F.coalesce(group(F.col("t"), r"gtx\s*(\d+)"), group(F.col("t"), r"rtx\s*(\d+)")).alias("v"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2
    assert [r.v for r in found.collect()] == ["4060", None, None]


def test_words_are_looked_for_as_patterns_match_them(evaluate):
    """Four more letters match an ASCII one when case does not count."""
    assert evaluate(folded(F.col("a")), ["RTX İIıſK", None]) == ["rtx iiisk", None]
    assert evaluate(vatan.cpu("a"), ["ſnapdragon X Elite", "RYZEN 7 7840HS", "ULTRA 7 258V"]) == ["Snapdragon X Elite", "Ryzen 7 7840HS", "Intel Ultra 7 258V"]
    assert evaluate(vatan.gpu("a"), ["Rtx 4060", "rAdeon 780m"]) == ["RTX 4060", "Radeon 780M"]
    assert evaluate(vatan.memory("a"), ["rtx 4060 8 GB 16 GB", "16 GB gddr6 8 GB", "4 gb vram 32 GB"])[1:] == ["16GB", "32GB"]
    assert evaluate(amazon.screen("a"), ["15,6 İnch", "14 EKran"]) == ['15.6"', '14"']
    assert evaluate(amazon.memory("a"), ["16 GB bELLEK", "Ram 32 gb", "512 GB SSD"])[:2] == ["16GB", "32GB"]
    assert evaluate(incehesap.gpu_text("a"), ["İRİS XE", "i̇ris xe", "MacBook"]) == ["IRIS XE", "iris xe", "Apple Integrated"]


def test_tags_written_in_any_way_are_read_alike():
    def seen(html):
        return [(e.tag, e.attrs, e.text()) for e in parse(html).walk()]

    plain = [("div", {"class": "a b", "id": "c"}, "x y"), ("b", {}, "y")]
    assert seen('<div class="a b" id="c">x<b>y</b></div>') == plain
    assert seen("<DIV  class='a b' ID=c >x<B >y</b ></div >") == plain
    assert seen('<a href="?a=1&amp;b=2">x</a>') == [("a", {"href": "?a=1&b=2"}, "x")]
    assert seen('<script>if (a <b class="x">)</script>z') == [("script", {}, "")]
    page = parse('<ul><li class="prd">1</li></ul><li class="prd">2</li>')
    assert [e.text() for e in page.find_all("li", "prd")] == ["1", "2"] and [e.text() for e in page.find("ul").find_all("li")] == ["1"]
