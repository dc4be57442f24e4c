import pytest

from shelfrank.functions import clean as C
from shelfrank.plans.prepare import clean_data, prepare


def golden(evaluate, expression, table):
    assert evaluate(expression, [k for k, _ in table]) == [v for _, v in table]


def test_price_text(evaluate):
    golden(evaluate, C.clean_price("a"), [
        ("24.999 TL", 24999), ("24.999,00 TL", None), ("4.500,00 TL", 450000), ("999", None), ("1000", 1000),
        ("500000", 500000), ("500001", None), ("yok", None), ("", None), (None, None), ("9" * 30, None),
    ])


def test_price_from_number_column(evaluate):
    golden(evaluate, C.clean_price("a", True), [("24999.9", 24999), ("24999.0", 24999), ("24999", 24999), ("x", None)])


def test_ram(evaluate):
    golden(evaluate, C.clean_ram("a"), [
        ("8GB + 8GB (16 GB)", 16), ("8GB+16GB", 16), ("64", 64), ("16.0", 16), ("x", 8), (None, 8), ("7", 8), ("16 gb", 16),
    ])


def test_ssd(evaluate):
    golden(evaluate, C.clean_ssd("a"), [
        ("1TB SSD", 1024), ("1000GB", 1024), ("500 GB", 512), ("1GB", 1024), ("2GB", 256), (None, 256), ("1024.0", 1024),
        ("99999999999999999TB", 256),
    ])


def test_screen(evaluate):
    golden(evaluate, C.parse_screen("a"), [
        ("14,0 inc", 14.0), ('16 . 1"', 16.1), ("144Hz 16.0", 14.0), ("1920x1080", 19.0), ("9.7", None), (None, None),
    ])


def test_brand(evaluate):
    golden(evaluate, C.extract_brand("a"), [
        ("MacBook Air", "apple"), ("HP Victus", "hp"), ("HPVictus", "hp"), ("Honor X14", "other"), (None, "other"),
        ("MSI-Katana", "msi"), ("mac", "other"), ("programlama", "asus"),
    ])


def test_os(evaluate):
    expression = C.detect_os("a", "b", "c")
    golden(evaluate, expression, [
        (("Yok", "x", "other"), "freedos"), (("ChromeOS", "x", "other"), "freedos"), ((None, "Win11 Pro", "other"), "windows"),
        ((None, "MacBook", "apple"), "macos"), ((None, "x", "apple"), "macos"), (("Ubuntu", "windows 11", "other"), "linux"),
        ((None, None, "other"), "freedos"),
    ])


def test_noise_and_stock(evaluate):
    golden(evaluate, C.is_noise_title("a"), [
        ("ÜRÜN SİLİNECEK laptop", True), ("Ürün Silinecek", True), ("ürün silinecek", True), ("laptop", False), (None, False),
    ])
    golden(evaluate, C.stock_status("a"), [
        ("Stokta var", "in_stock"), ("TÜKENDİ", "out_of_stock"), ("Tükendi, stokta yok", "out_of_stock"),
        ("Aynı Gün kargo", "in_stock"), ("x", "unknown"), (None, "unknown"),
    ])


def test_blocked_page(evaluate):
    golden(evaluate, C.is_blocked_page("a"), [
        ("", True), (None, True), ("<p>Captcha</p>", True), ("Enter the Characters You See Below", True), ("<p>ok</p>", False),
    ])


def test_clean_data_defaults_and_row_filter(spark):
    raw = spark.createDataFrame(
        [("A", "6.000 TL", "1TB"), ("B", "5.000 TL", None), (None, "9.000 TL", None), ("C", None, None)],
        " Name string, PRICE string, Storage string",
    )
    rows = clean_data(raw).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["name"], r["price"], r["ram_gb"], r["ssd_gb"], r["screen_size"]) == ("A", 6000, 8, 1024, 15.6)
    assert (r["cpu_score"], r["gpu_score"], r["brand"], r["os"]) == (5.0, 3.0, "other", "freedos")
    p = prepare(raw).collect()[0]
    assert (p.cpu_score, p.gpu_score, p.gpu_norm) == (5.0, 3.0, "Integrated (generic)")


def test_clean_data_takes_number_columns(spark):
    raw = spark.createDataFrame([("A", 24999.9, 16.0)], "name string, price double, ram double")
    r = clean_data(raw).collect()[0]
    assert (r.price, r.ram_gb) == (24999, 16)


def test_clean_data_needs_a_price(spark):
    with pytest.raises(ValueError):
        clean_data(spark.createDataFrame([("A",)], "name string"))
