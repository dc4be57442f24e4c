from pyspark.sql import functions as F

from shelfrank.functions import amazon, incehesap, mediamarkt, vatan


def check(evaluate, expression, table):
    assert evaluate(expression, [k for k, _ in table]) == [v for _, v in table]


def test_mediamarkt_examples(evaluate):
    check(evaluate, mediamarkt.cpu("a"), [
        ("Apple Macbook Pro Apple M5 islemci", "m5"), ("Lenovo Legion AMD Ryzen 7 8840HS Gaming Laptop", "ryzen 7 8840hs"),
        ("HP Snapdragon X Elite 80-100", "snapdragon x elite"), ("ASUS Intel Core i7-13620H 16GB", "i7-13620h"),
        ("Macbook Pro M4 Max", "m4 max"), ("Ryzen AI 7 350", "ryzen ai 7 350"), ("Core Ultra 7 155H", "ultra 7 155h"),
        ("Intel laptop", "intel"), ("laptop", None),
    ])
    check(evaluate, mediamarkt.os("a"), [("Apple Macbook Air M4", "macOS"), ("ASUS Gaming W11", "Windows 11"), ("ASUS", None)])
    assert evaluate(mediamarkt.gpu_tag("a", F.lit("integrated")), ["Apple Macbook Air M4"]) == ["apple integrated"]
    check(evaluate, mediamarkt.os("a", F.col("b")), [
        (("ASUS", "Isletim Sistemi: FreeDOS\nx"), "FreeDOS"), (("ASUS W11", "isletim sistemi: ?"), "Windows 11"),
    ])
    check(evaluate, mediamarkt.labelled_value("a", mediamarkt.OS_LABELS), [
        ("x\nOperating System :- \n Linux \ny", "Linux"), ("isletim sistemi:", None), ("nothing", None),
    ])
    check(evaluate, mediamarkt.price("a"), [("24.999,90 TL", 24999.9), ("9.999 TL", None), ("TL", None)])


def test_amazon_price(evaluate):
    check(evaluate, amazon.price("a"), [
        ("24.999,00 TL", 24999), ("18.499 TL", 18499), ("18,499 TL", 18499), ("18 499,00 TL", 18499), ("18,50", 18), ("19,50", 20),
        ("", None), (None, None), ("1,2,33.4,5", None),
    ])


def test_amazon_titles(evaluate):
    check(evaluate, amazon.storage("a"), [
        ("1 TB", "1GB"), ("1 TB SSD", "1TB"), ("SSD 512 GB", "512GB"), ("laptop", "512GB"), ("", "256GB"),
    ])
    check(evaluate, amazon.memory("a"), [
        ("16 GB RAM 512 GB SSD", "16GB"), ("512GB SSD i7-13700H", "16GB"), ("512GB SSD i7", "8GB"), ("512GB SSD", "8GB"), ("8GB RAM 128GB SSD", "8GB"), (None, "8GB"),
    ])
    check(evaluate, amazon.cpu("a"), [
        ("Core i7", "i7"), ("i7 13700H", "i7-13700"), ("Ryzen 9", "Ryzen 9"), ("Ryzen 5 7535U", "Ryzen 5 7535"), ("Celeron", "Celeron"),
        ("MacBook", "M2"), ("laptop", "i5"), ("Ultra 7", "Ultra 7"), ("", None),
    ])
    check(evaluate, amazon.os("a"), [("MacBook", "macOS"), ("chromebook", "ChromeOS"), ("x", "FreeDOS"), ("a dos b", "FreeDOS"), ("Win11", "Windows 11")])
    check(evaluate, amazon.gpu("a"), [("RTX4060", "rtx 4060"), ("Legion", "rtx 3050"), ("MacBook", "apple integrated"), ("x", "integrated")])
    check(evaluate, amazon.screen("a"), [("15,6 inç", '15.6"'), ("air", '13.3"'), ("144 hz 14\"", '14"'), ("x", '15.6"')])


def test_incehesap(evaluate):
    check(evaluate, incehesap.price("a"), [
        ("35", 35000.0), ("35.999 TL", 35999.0), ("35.999,90 ₺", 35999.9), ("4.000", None), ("600000", None), ("1000", None), ("yok", None),
    ])
    check(evaluate, incehesap.cpu_family("a"), [
        ("Intel Core i5-13500H", "i5"), ("Ryzen 7 7840HS", "ryzen7"), ("Apple M3", "m3"), ("Core Ultra 7", "ultra7"), ("Core 7 240H", "core7"),
        ("Core İ5", "i5"), ("Celeron N", "celeron n"), (None, ""),
    ])
    check(evaluate, incehesap.gpu_tag("a", "b"), [
        (("RTX 4060 Ti", "Laptop"), "rtx4060"), (("RTX 4060", "MacBook"), "apple integrated"), (("", "Mac mini"), "apple integrated"),
        (("nan", "gaming"), "integrated"), (("Radeon 680M", "x"), "rx680m"), (("RX 7600S", "x"), "rx7600s"), (("Arc Graphics", "x"), "intel arc"),
        (("Radeon Graphics", "x"), "integrated"),
    ])
    check(evaluate, incehesap.brand_word("a"), [("(Msi) Katana", "MSI"), ("lenovo x", "Lenovo"), ("e-machines x", "E-Machines"), ("", "")])
    check(evaluate, incehesap.model_words("a"), [("Asus  TUF  F15", "TUF F15"), ("Asus", "")])
    check(evaluate, incehesap.os("a"), [("W11Pro", "Windows 11"), ("W11Px", ""), ("Free Dos", "FreeDOS"), ("Sonoma", "macOS"), ("x", "")])
    check(evaluate, incehesap.screen("a"), [("14 inç", 14.0), ("15,6 x", 15.6), ("20.1 inch", None), ("14 x", None)])
    check(evaluate, incehesap.storage("a"), [("1 TB", 1024), ("512GB", 512), ("99TB", None), ("32GB", None)])


def test_vatan_screen_skips_generations(evaluate):
    check(evaluate, vatan.screen("a"), [
        ('Casper 15.6" x', '15.6"'), ("i5 14 laptop", '14.0"'), ("gen 16", '15.6"'), ("NESİL 16", '16.0"'), ("x", '15.6"'),
        ("11 17.3", '17.3"'), ("Nesil 13 ve sonra uzun 16.0 FHD", '16.0"'), ("nesil 1234 17", '17.0"'),
    ])


def test_vatan_memory(evaluate):
    check(evaluate, vatan.memory("a"), [
        ("16GB RAM 512GB SSD RTX4050 6GB", "16GB"), ("SSD 128 GB 8 GB", "8GB"), ("storage    64 gb", "64GB"), ("storage 64 gb", "8GB"),
        ("gddr6 8gb 12 gb", "12GB"), ("6 GB VRAM", "8GB"), ("2GB", "8GB"), ("64 GB eMMC", "8GB"), ("8GB 16 GB", "16GB"),
    ])


def test_vatan_others(evaluate):
    check(evaluate, vatan.clean_name("a"), [("Laptop X 12.345 TL", "Laptop X"), ("Laptop 12.345", "Laptop"), ("Laptop", "Laptop")])
    check(evaluate, vatan.cpu("a"), [
        ("Intel Core i5 13420H", "I5-13420H"), ("Core 5 120U", "Intel Core 5 120U"), ("Core Ultra 7 155H", "Intel Ultra 7 155H"),
        ("AMD Ryzen 5 7535HS", "Ryzen 5 7535HS"), ("Ryzen AI 9 365", "Ryzen AI 9 365"), ("m4 pro", "M4 Pro"), ("Intel N100", "Intel N100"),
        ("x", "Intel Core i5"),
    ])
    check(evaluate, vatan.gpu("a"), [
        ("RTX 5070", "RTX 5070"), ("Radeon RX 7600M", "RX 7600M"), ("Radeon 7600", "RX 7600"), ("Radeon 780M", "Radeon 780M"),
        ("MacBook M3", "Apple M3 GPU"), ("Iris", "Intel Iris"), ("x", "Integrated"),
    ])
    check(evaluate, vatan.os("a"), [("Windows 8", "windows"), ("kudos", "FreeDOS"), ("Apple", "macOS"), ("x", "FreeDOS")])
