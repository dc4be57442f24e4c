import pytest

from shelfrank.plans import page_listings as PL
from shelfrank.sources import pages as P
from shelfrank.sources.html import parse

VATAN = """<html><div class="product-list"><a href="/urun/1"></a><div class="product-list__product-name"><h3>Asus TUF i5 16GB 15.6" 24.999 TL</h3></div>
<span class="product-list__price">24.999 TL</span></div>
<div class="product-list"><a href="/urun/2"></a><h3>Kisa ad</h3><span class="product-list__price">24.999 TL</span></div>
<div class="product-list"><a href="urun/3"></a><h3>Fiyatsiz bir laptop</h3></div></html>"""
AMAZON = """<div data-component-type="s-search-result" data-asin="B1"><span class="s-label-popover-default">Sponsored</span><h2><span>x</span></h2></div>
<div data-component-type="s-search-result" data-asin="B2"><h2><span>Lenovo Legion RTX 4060</span></h2>
<span class="a-price"><span class="a-offscreen">31.499,50 TL</span></span></div>
<div data-component-type="s-search-result"><h2><a class="a-link-normal" href="/x"><span>Asus Core i7 13700H</span></a></h2></div>
<div data-component-type="s-search-result"><h2><span>no link</span></h2></div>"""
DETAIL = """<h1>Asus &amp; TUF <b>F15</b></h1><div class="big Price">yok</div><span class="fiyat">35.999,90 TL</span>
<table><tr><td>RAM</td><td>16 GB</td></tr></table><dl><dt>SSD</dt><dd>1 TB</dd></dl><ul class="teknik"><li>RTX 4060</li><li>15,6 inç</li></ul>
<div class="stok">Tükendi</div><span class="kargo">Stokta</span>"""


@pytest.fixture
def page(spark):
    return lambda *html: spark.createDataFrame(
        [(i, f"https://shop.example/p/{i}?q=1", h) for i, h in enumerate(html)], "page_id long, url string, html string"
    )


def test_tree():
    root = parse("<div class='a b'>x<br>y<p>z</div><span>t</span><script>no</script>")
    assert root.find("div", "^b$").tidy_text() == "x y z" and root.find("span").text() == "t" and root.text() == "x y z t"


def test_vatan_cards(page):
    got = PL.vatan_listings(page(VATAN, "")).collect()
    assert [(r.url, r.name, r.price, r.ram, r.screen_size) for r in got] == [
        ("https://shop.example/urun/1", 'Asus TUF i5 16GB 15.6"', 24999.0, "16GB", '15.6"')
    ]


def test_amazon_cards_and_blocked_pages(page):
    got = {r.name: r for r in PL.amazon_listings(page(AMAZON, AMAZON + "captcha")).collect()}
    assert set(got) == {"Lenovo Legion RTX 4060", "Asus Core i7 13700H"}
    first, second = got["Lenovo Legion RTX 4060"], got["Asus Core i7 13700H"]
    assert (first.url, int(first.price), first.gpu) == ("https://shop.example/dp/B2", 31500, "rtx4060")
    assert (second.url, second.price, second.cpu) == ("https://shop.example/x", None, "I7-13700")


def test_details(page):
    r = PL.product_details(page(DETAIL)).collect()[0]
    assert (r.title, r.price_try, r.stock_status) == ("Asus & TUF F15", 35999.9, "out_of_stock")
    assert (r.brand, r.model, r.ram_gb, r.storage_gb, r.screen_inch, r.gpu) == ("ASUS", "& TUF F15", 16, 1024, 15.6, "RTX 4060")


def test_card_fills_gaps_and_noise_goes(page, spark):
    cards = """<ul><li class="prd"><a class="prd-link" href="/d/1">a</a><h3 class="prd-title">Asus kart</h3><div class="price">25.000</div></li>
    <li class="prd"><a class="prd-link" href="/d/2">Dell kart</a><span class="fiyat">26.000</span></li>
    <li class="prd"><a class="prd-link" href="/d/3">Ürün Silinecek</a></li></ul>"""
    details = spark.createDataFrame(
        [(1, "https://shop.example/d/1", "<h1></h1><div class='stok'>Stokta</div><table><tr><td>i5-13420H</td></tr></table>")],
        "page_id long, url string, html string",
    )
    got = {r.url[-1]: r for r in PL.incehesap_listings(page(cards), details).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].name, float(got["1"].price), got["1"].cpu) == ("Asus kart", 25000.0, "i5")
    assert (got["2"].name, float(got["2"].price), got["2"].gpu) == ("Dell kart", 26000.0, "integrated")


def test_mediamarkt_cards(page):
    html = "<article><a href='/tr/product/1'>Yeni</a><p>ASUS TUF Gaming Laptop i7-13620H 16 GB RAM</p><p>34.999 TL</p></article>"
    html += "<article><p>ASUS TUF Gaming Laptop i7-13620H 16 GB RAM</p><p>33.999 TL</p></article><article><p>kisa</p></article>"
    got = PL.mediamarkt_listings(page(html)).collect()
    assert [(r.url, float(r.price), r.cpu, r.ram) for r in got] == [("https://shop.example/tr/product/1", 34999.0, "i7-13620h", "16GB")]


def test_links_titles_prices(page):
    html = """<h2 class="title">İki  <i>kat</i></h2><a href="/urun/1">a</a><a href="b/c">b</a><a href="#t">c</a><a href="?p=2">d</a>
    <a href="//cdn.example/x">e</a><a href="http://o.example/notebook-1">f</a><p class="price">yok</p><strong class="x fiyat">19.999</strong>"""
    df = page(html)
    assert df.select(P.page_title("html")).first()[0] == "İki kat"
    assert df.select(P.first_price(P.price_texts("html"))).first()[0] == 19999.0
    got = [(r.link, r.is_product) for r in P.page_links(df).orderBy("pos").collect()]
    assert got == [
        ("https://shop.example/urun/1", True), ("https://shop.example/p/b/c", False), ("https://shop.example/p/0?q=1#t", False),
        ("https://shop.example/p/0?p=2", False), ("https://cdn.example/x", False), ("http://o.example/notebook-1", True),
    ]


def test_deep_pages_are_read(page):
    deep = "<p>" * 10_000 + "<li>" * 5_000 + "<div>" * 5_000 + "<h1>deep</h1><a href='/urun/9'>x</a>" + "</table>" * 1000
    df = page(deep)
    assert df.select(P.page_title("html")).first()[0] == "deep"
    assert P.page_links(df).first().link == "https://shop.example/urun/9"


def test_all_readings_of_a_page_agree(page):
    html = """<h1> </h1><h2 class="title">T2</h2><span class="price">21.000 TL</span><div class="price"><b>22</b>.<i>000</i> TL</div><div class="price">23.000 TL</div>"""
    df = page(html)
    assert df.select(P.page_title("html")).first()[0] is None and PL.product_details(df).first().title == ""
    assert df.select(P.price_texts("html")).first()[0] == ["22 . 000 TL", "23.000 TL", "21.000 TL"]
    assert df.select(P.first_price(P.price_texts("html"))).first()[0] == PL.product_details(df).first().price_try


def test_odd_links(page):
    html = """<link href="/style.css"><a href='/urun/1'>a</a><a href="/x?a=1&amp;b=2">b</a><a href="a/b/../urun/2">c</a><a>d</a><a href="http://[bad">e</a>"""
    got = [r.link for r in P.page_links(page(html)).orderBy("pos").collect()]
    assert got == ["https://shop.example/urun/1", "https://shop.example/x?a=1&b=2", "https://shop.example/p/a/urun/2", "http://[bad"]


def test_product_links_are_cards_where_there_are_none(page, spark):
    details = spark.createDataFrame([], "page_id long, url string, html string")
    got = PL.incehesap_listings(page("<a href='/urun/1'>Asus A</a><a href='/about'>x</a><p><a href='/laptop-2'>Dell B</a></p>"), details).collect()
    assert sorted((r.url, r.name) for r in got) == [("https://shop.example/laptop-2", "Dell B"), ("https://shop.example/urun/1", "Asus A")]


def test_repeated_cards_and_pages_give_one_row(page, spark):
    card = "<ul><li class='prd'><a class='prd-link' href='/d/1'>a</a><h3 class='prd-title'>Asus kart</h3><div class='price'>25.000</div></li></ul>"
    details = spark.createDataFrame([(i, "https://shop.example/d/1", f"<h1>Asus sayfa {i}</h1>") for i in (3, 2, 5)], "page_id long, url string, html string")
    got = PL.incehesap_listings(page(card, card, card * 3), details).collect()
    assert [(r.name, r.price) for r in got] == [("Asus sayfa 2", 25000.0)]


def test_empty_name_falls_back_to_the_content_block(page):
    html = """<div class="product-list"><a href="/urun/1"></a><h3> </h3><div class="product-list__content">Lenovo Legion i7 32GB</div>
    <span class="product-list__price">44.999 TL</span></div>"""
    assert [r.name for r in PL.vatan_listings(page(html)).collect()] == ["Lenovo Legion i7 32GB"]
