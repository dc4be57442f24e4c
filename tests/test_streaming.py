from shelfrank.sources import history as H
from shelfrank.sources.history import source_of
from shelfrank.streaming import history_stream as HS

HEADER = "url,name,price,screen_size,ssd,cpu,ram,os,gpu\n"


def test_append_counts_each_file_once(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "history"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "amazon_laptops.csv").write_text(HEADER + "u1,a,1,,,,,,\nu2,b,2,,,,,,\n")
    run = lambda: HS.append_stream(HS.listing_stream(spark, str(folder)), table, state).awaitTermination()
    run()
    run()
    assert H.read(spark, table).count() == 2
    (folder / "vatan_laptops.csv").write_text(HEADER + "u3,c,3,,,,,,\n")
    run()
    assert {(r.url, r.source) for r in H.read(spark, table).collect()} == {("u1", "amazon"), ("u2", "amazon"), ("u3", "vatan")}


def test_streams_and_batches_share_a_table(spark, tmp_path):
    table = str(tmp_path / "history")
    rows = spark.createDataFrame([("u0", "amazon")], "url string, source string")
    assert H.append(rows, table) == 1
    for i in range(2):  # both start with batch 0
        folder = tmp_path / f"in{i}"
        folder.mkdir()
        (folder / "amazon_laptops.csv").write_text(HEADER + f"s{i},a,1,,,,,,\n")
        HS.append_stream(HS.listing_stream(spark, str(folder)), table, str(tmp_path / f"state{i}")).awaitTermination()
    assert sorted(r.url for r in H.read(spark, table).collect()) == ["s0", "s1", "u0"]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = str(tmp_path / "history")
    rows = spark.createDataFrame([("u1", "amazon"), ("u2", "vatan")], "url string, source string")
    for _ in range(3):
        HS._add(rows, table, HS.run_id("state"), 0)
    HS._add(rows, table, HS.run_id("state"), 1)
    HS._add(rows, table, HS.run_id("other"), 0)
    assert H.read(spark, table).count() == 6


def test_files_under_their_own_headers(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "history"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "amazon_laptops.csv").write_text("\ufeffurl,name,price\nu1,\"a, b\",1\n", "utf-8")
    (folder / "vatan_laptops.csv").write_text("Fiyat;urun;url\n2;b;u2\n\n3;c;u3\n")
    run = lambda: HS.append_files(spark, str(folder), table, state).awaitTermination()
    run()
    (folder / "late_laptops.csv").write_text("price|name\n4|d\n")
    run()
    run()
    assert {(r.source, r.url, r.name, r.price) for r in H.read(spark, table).collect()} == {
        ("amazon", "u1", "a, b", "1"), ("vatan", "u2", "b", "2"), ("vatan", "u3", "c", "3"), ("late", None, "d", "4"),
    }


def test_first_sightings_do_not_forget(spark, tmp_path):
    """Three batches, each later than any delay; a url that came long ago and a late row."""
    source = tmp_path / "rows"
    batches = [[("u1", "2024-01-01"), (None, "2024-01-01")], [("u2", "2024-06-01"), ("u1", "2024-06-01"), (None, "2024-06-02")], [("u3", "2023-01-01"), ("u1", "2024-12-01")]]
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "url string, at string").selectExpr("url", "timestamp(at) AS scraped_at").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("url string, scraped_at timestamp").parquet(str(source))
        got = HS.run_to_table(HS.first_sightings(stream), str(tmp_path / "out"), str(tmp_path / "state"))
        out.append(sorted(str(r.url) for r in got.collect()))
    assert out == [["None", "u1"], ["None", "u1", "u2"], ["None", "u1", "u2", "u3"]]


def test_first_sightings_with_a_delay(spark, tmp_path):
    source = str(tmp_path / "rows")
    rows = "VALUES ('u1', timestamp'2024-01-01'), ('u2', timestamp'2024-01-01'), ('u1', timestamp'2024-01-03') AS t(url, scraped_at)"
    spark.sql(f"SELECT * FROM {rows}").write.parquet(source)
    stream = spark.readStream.schema("url string, scraped_at timestamp").parquet(source)
    got = HS.run_to_table(HS.first_sightings(stream, delay="7 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.url for r in got.collect()) == ["u1", "u2"]


def test_source_name(spark):
    df = spark.createDataFrame([("amazon_laptops.csv",), ("dir/vatan_laptops.csv",), ("x.csv",)], "f string")
    assert [r[0] for r in df.select(source_of("f")).collect()] == ["amazon", "vatan", "x"]
