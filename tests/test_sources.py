import datetime

import pytest

from shelfrank.plans.prepare import clean_data
from shelfrank.session import local_root
from shelfrank.sources import csv_files as C
from shelfrank.sources import history as H
from shelfrank.sources.listings import as_listing, rename_aliases


@pytest.fixture
def shops(tmp_path):
    folder = tmp_path / "shop files"
    folder.mkdir()
    (folder / "amazon_laptops.csv").write_text("﻿url,Name,PRICE \nu1,Asus A,24.999 TL\nu1,Asus A,23.999 TL\n,nan,N/A\n", "utf-8")
    (folder / "incehesap_laptops.csv").write_text("url;name;price;ram\nu2;Dell B;24999.0;16.0\nu3;Dell C;;8\n", "utf-8")
    (folder / "vatan_laptops.csv").write_bytes(b"name|price\nbad \xff byte|9.999 TL\n")
    (folder / "empty.csv").write_text("")
    (folder / "header_only.csv").write_text("url,name\n")
    (folder / "notes.txt").write_text("x")
    return str(folder)


def test_read_folder(spark, shops):
    df = C.read_folder(spark, shops)
    got = {(r.source_file, r.url, r.name, r.price, r.ram, r.price_is_number) for r in df.collect()}
    assert got == {
        ("amazon_laptops.csv", "u1", "Asus A", "24.999 TL", None, False), ("amazon_laptops.csv", "u1", "Asus A", "23.999 TL", None, False),
        ("amazon_laptops.csv", None, None, None, None, False), ("incehesap_laptops.csv", "u2", "Dell B", "24999.0", "16.0", True),
        ("incehesap_laptops.csv", "u3", "Dell C", None, "8", True), ("vatan_laptops.csv", None, "bad � byte", "9.999 TL", None, False),
    }
    ordered = [(r.source_file, r.price) for r in df.orderBy("seq").collect()]
    assert [o[0] for o in ordered] == sorted(o[0] for o in ordered) and ordered[0][1] == "24.999 TL"
    assert sorted(r.price for r in clean_data(df).collect()) == [9999, 23999, 24999, 24999]
    assert all(r.broken_line is None for r in df.collect())
    assert {r.source_file: r.n_rows for r in C.inventory(spark, shops).collect()} == {
        "amazon_laptops.csv": 3, "incehesap_laptops.csv": 2, "vatan_laptops.csv": 1, "empty.csv": 0, "header_only.csv": 0,
    }
    assert C.status(spark, shops) == "Loaded 6 rows from 3 CSV files"


def test_lines_that_do_not_fit_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,price\nx,1\ny,2,3\nz\n")
    got = {r.name: r.broken_line for r in C.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"x": None, "y": "y,2,3", "z": "z"}


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i}.csv").write_text("name,price\nx,1\n")
        group = f"files-{n}"
        spark.sparkContext.setJobGroup(group, group)
        C.read_folder(spark, str(folder), numeric_price=False)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(20) <= jobs(2) + 1


def test_a_shared_folder_is_needed_on_a_cluster():
    assert local_root("local[4]") and local_root("local")
    for master in ("yarn", "k8s://x", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            local_root(master)


def test_number_flag_can_be_given(spark, shops):
    df = C.read_folder(spark, shops, numeric_price={"vatan_laptops.csv": True})
    assert {r.source_file for r in df.where("price_is_number").collect()} == {"vatan_laptops.csv"}


def test_no_files(spark, tmp_path):
    assert C.read_folder(spark, str(tmp_path)) is None
    assert C.read_folder(spark, str(tmp_path / "absent")) is None
    assert C.snapshot(spark, str(tmp_path), str(tmp_path / "cache")) is None
    assert C.status(spark, str(tmp_path)) == f"No CSV files found in {tmp_path}"
    assert C.status(spark, str(tmp_path / "absent")) == f"Data directory not found at {tmp_path / 'absent'}"
    (tmp_path / "only_header.csv").write_text("name,price\n")
    assert C.status(spark, str(tmp_path)) == "Found 1 CSV files but none contained usable rows"


def test_snapshot_follows_its_input(spark, shops, tmp_path):
    cache = str(tmp_path / "cache")
    assert C.snapshot(spark, shops, cache).count() == 6
    assert C.snapshot(spark, shops, cache).count() == 6
    assert len(list((tmp_path / "cache").iterdir())) == 1
    with open(f"{shops}/vatan_laptops.csv", "ab") as f:
        f.write(b"more|8.888 TL\n")
    assert C.snapshot(spark, shops, cache).count() == 7


def test_aliases(spark):
    df = spark.createDataFrame([("1", "n", "m")], "fiyat string, urun string, title string")
    assert rename_aliases(df).columns == ["price", "urun", "name"]
    assert as_listing(rename_aliases(df)).columns == ["url", "name", "price", "screen_size", "ssd", "cpu", "ram", "os", "gpu"]


def test_sniff():
    assert [C.sniff_delimiter(h) for h in ("a,b", "a;b;c", "a\tb", "a|b", "a", "a;b,c")] == [",", ";", "\t", "|", ",", ","]


def test_rows_vote_on_the_delimiter(spark, tmp_path):
    """Headers with more marks of another kind than the delimiter, quoted marks, and the same header under two delimiters."""
    (tmp_path / "a.csv").write_text("url;name, brand, model;price\nu1;Asus A;1\nu2;Dell, B;2\n")
    (tmp_path / "b.csv").write_text('url|"name; shop; city"|price\n"u|3"|"c;d"|3\nu4|"open, ""quote"""|4\n')
    (tmp_path / "c.csv").write_text("url,name;price\nu5,x;5\nu6,y;6\n")
    (tmp_path / "d.csv").write_text("url,name;price\nu7 a,b c\nu8,d\n")
    (tmp_path / "e.csv").write_text("url;name,price,ram\n")
    found = {p.rsplit("/", 1)[1]: sep for (_, sep), paths in C._headers(spark, str(tmp_path), "*.csv", False).items() for p in paths}
    assert found == {"a.csv": ";", "b.csv": "|", "c.csv": ",", "d.csv": ",", "e.csv": ","}
    rows = C.read_folder(spark, str(tmp_path), pattern="[ab].csv").orderBy("price").collect()
    assert [(r.url, r.price, r.broken_line) for r in rows] == [("u1", "1", None), ("u2", "2", None), ("u|3", "3", None), ("u4", "4", None)]


def test_csv_export_has_a_mark_and_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', " padded "), ("ü", None)], "name string, note string")
    C.save_csv(df, str(tmp_path / "out"))
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("*.csv")]
    assert all(p.startswith("﻿name,note".encode()) for p in parts)
    back = C.read_folder(spark, str(tmp_path / "out"))
    assert {(r.name, r.note) for r in back.collect()} == {('say "hi"', " padded "), ("ü", None)}


def test_history(spark, shops, tmp_path):
    table = str(tmp_path / "history")
    rows = as_listing(C.read_folder(spark, shops)).withColumn("source_file", C.F.lit("amazon_laptops.csv"))
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert H.append(rows, table, at) == 6 and H.append(rows, table) == 6
    stored = H.read(spark, table)
    assert stored.count() == 12 and stored.where("source = 'amazon'").count() == 12
    assert stored.where("scraped_at = timestamp'2024-01-02 03:04:05'").count() == 6
    fresh = spark.createDataFrame([("u1",), ("u9",), (None,)], "url string")
    assert sorted(str(r.url) for r in H.new_listings(fresh, stored).collect()) == ["None", "u9"]
