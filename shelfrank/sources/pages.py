"""Fetched pages to product fields.

What a page holds (titles, prices, links, cards, specification blocks) comes from one
reading of its elements, in an Arrow-batched function; everything after it is column
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions import incehesap, mediamarkt
from shelfrank.functions.text import col, contains_any, matches
from shelfrank.sources.html import Element, parse

# The elements that hold each field.
TITLE_ELEMENTS = [("h1", None), ("h2", "(?i)title"), ("div", "(?i)product.*title|name")]
PRICE_CLASS = "(?i)price|fiyat"
PRICE_ELEMENTS = [(tag, PRICE_CLASS) for tag in ("div", "span", "strong", "p")]
STOCK_ELEMENTS = [
    ("div", "(?i)stock|stok"), ("div", "(?i)cargo|kargo|teslim|delivery"), ("span", "(?i)stock|stok|kargo|teslim"),
]
SPEC_ELEMENTS = [
    ("table", None), ("dl", None), ("ul", "(?i)spec|ozellik|özellik|tech|teknik"),
    ("div", "(?i)spec|ozellik|product.*detail|teknik|tech"),
]
CARD_TITLE_ELEMENTS = [
    ("h3", "(?i)(product|prd).*title"), ("h2", "(?i)(product|prd).*title"), ("a", "(?i)title|name"),
    ("div", "(?i)title|name"),
]
PRODUCT_LINK = r"/urun/|/notebook-|/laptop-"
BRAND_WORDS = [
    "asus", "lenovo", "hp", "dell", "acer", "msi", "apple", "macbook", "monster", "casper", "huawei", "samsung",
    "laptop", "notebook",
]

CARD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "name", "price_text", "specs")]
)
DETAIL = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("price_texts", T.ArrayType(T.StringType())),
        T.StructField("stock_hints", T.ArrayType(T.StringType())),
        T.StructField("specs", T.ArrayType(T.StringType())),
    ]
)


def page_title(html: Column | str) -> Column:
    """Text of the first main heading, else of a titled second heading or name block; null without one or if blank."""
    return F.nullif(detail_fields(col(html))["title"], F.lit(""))


def price_texts(html: Column | str) -> Column:
    """Whole texts of the elements whose class names a price, kind of element by kind."""
    return detail_fields(col(html))["price_texts"]


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: its place on the page, absolute address, and whether it is a product link."""

    @F.pandas_udf("array<struct<href:string,link:string>>")
    def links(html: pd.Series, url: pd.Series) -> pd.Series:
        found = ([a.attrs["href"] or "" for a in parse(h).find_all("a") if "href" in a.attrs] for h in html)
        return pd.Series([[{"href": x, "link": _joined(u or "", x)} for x in row] for row, u in zip(found, url)])

    found = pages.select("page_id", F.posexplode(links("html", "url")).alias("pos", "a"))
    return found.select("page_id", "pos", F.col("a.link").alias("link"), F.col("a.href").rlike(PRODUCT_LINK).alias("is_product"))


def _joined(base: str, href: str) -> str:
    """The address a link leads to; one that can't be read stays as it is."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def first_price(texts: Column) -> Column:
    """First text that holds a price."""
    plain = F.transform(F.transform(texts, incehesap.tidy_price), incehesap.plain_price)  # each step once a text
    return F.get(F.filter(F.transform(plain, incehesap.price_of), lambda p: p.isNotNull()), F.lit(0))


def card_lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def card_name(text: Column | str) -> Column:
    """First line over 20 characters with a brand word in it."""
    fits = lambda x: (F.length(x) > 20) & contains_any(F.lower(x), BRAND_WORDS)
    return F.get(F.filter(card_lines(text), fits), F.lit(0))


def card_price(text: Column | str) -> Column:
    """First price among the lines that look like one."""
    looks = lambda x: x.contains("TL") | matches(x, r"\d{2}\.\d{3}")
    prices = F.transform(F.filter(card_lines(text), looks), mediamarkt.price)
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


# --- nested elements ----------------------------------------------------------------


def _detail(html: str) -> tuple:
    page = parse(html)
    heading = next((e for tag, c in TITLE_ELEMENTS if (e := page.find(tag, c))), None)

    def texts(elements):
        return [e.tidy_text() for tag, c in elements for e in page.find_all(tag, c)]

    return (
        heading.tidy_text() if heading else "",
        texts(PRICE_ELEMENTS),
        texts(STOCK_ELEMENTS),
        [t for t in texts(SPEC_ELEMENTS) if t],
    )


@F.pandas_udf(DETAIL)
def detail_fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title, price texts, stock hints and specification texts of a product page."""
    for html in batches:
        yield pd.DataFrame([_detail(h) for h in html], columns=DETAIL.names)


def _amazon_cards(page: Element, base: str):
    for card in page.find_all("div"):
        if card.attrs.get("data-component-type") != "s-search-result":
            continue
        badge = card.find("span", r"^s-label-popover-default$")
        if badge and "sponsored" in badge.text("").lower():
            continue
        title = card.path(("h2", None), ("a", None), ("span", None)) or card.path(("h2", None), ("span", None))
        if title is None:
            continue
        link = card.path(("h2", None), ("a", r"^a-link-normal$"))
        href, asin = (link.attrs.get("href") if link else None), card.attrs.get("data-asin")
        url = _joined(base, href) if href else _joined(base, f"/dp/{asin}") if asin else None
        if url is None:
            continue
        price = card.path(("span", r"^a-price$"), ("span", r"^a-offscreen$")) or card.find("span", r"^a-price-whole$")
        yield url, title.text(""), price.text("") if price else None, None


def _vatan_cards(page: Element, base: str):
    kinds = [r"^product-list$", r"^wrapper product$", r"^product-card$", r"^product-list__product$"]
    cards = next((found for k in kinds if (found := page.find_all("div", k))), [])
    for card in cards:
        link = next((a for a in card.find_all("a") if a.attrs.get("href") is not None), None)
        if link is None:
            continue
        block = next((e for e in card.walk() if e.has_class(r"^product-list__product-name$")), None)
        name = (block and block.find("h3")) or block or card.find("h3")
        title = name.text() if name else ""
        if not title:
            other = card.find("div", r"^product-list__content$")
            title = other.text() if other else ""
        price = (
            card.find("span", r"^product-list__price$") or card.find("div", r"^price-box$") or card.find("span", r"^price$")
        )
        yield _joined(base, link.attrs["href"] or ""), title, price.text("") if price else "", card.text()


def _incehesap_cards(page: Element, base: str):
    cards = [
        *page.find_all("div", "product-card|productItem|product|prd-card"),
        *page.find_all("li", "product|prd"),
        *[d for d in page.find_all("div") if d.attrs.get("data-product-id") is not None],
    ]
    if not cards:  # then every product link is a card
        cards = [a for a in page.find_all("a") if re.search(PRODUCT_LINK, a.attrs.get("href") or "")]
    unique = list({id(c): c for c in cards}.values())
    for card in unique:
        links = [a for a in ([card] if card.tag == "a" else card.find_all("a")) if a.attrs.get("href")]
        link = next((a for a in links if a.has_class("product-link|prd-link|title|name")), None) or next(iter(links), None)
        if link is None:
            continue
        heading = next((e for tag, c in CARD_TITLE_ELEMENTS if (e := card.find(tag, c))), None) or link
        price = card.find("div", PRICE_CLASS) or card.find("span", PRICE_CLASS)
        yield _joined(base, link.attrs["href"]), heading.tidy_text(), price.tidy_text() if price else "", None


def _mediamarkt_cards(page: Element, base: str):
    for card in page.find_all("article"):
        link = next((a for a in card.find_all("a") if "/tr/product/" in (a.attrs.get("href") or "")), None)
        yield _joined(base, link.attrs["href"]) if link else "", None, None, card.text("\n")


_READERS = {
    "amazon": _amazon_cards, "vatan": _vatan_cards, "incehesap": _incehesap_cards, "mediamarkt": _mediamarkt_cards,
}


def cards(pages: DataFrame, shop: str) -> DataFrame:
    """One row per product card of list pages: ``page_id pos url name price_text specs``."""
    read = _READERS[shop]

    @F.pandas_udf(T.ArrayType(CARD))
    def card_fields(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(CARD.names, c)) for c in read(parse(h), u or "")] for h, u in zip(html, url)])

    found = pages.select("page_id", F.posexplode(card_fields("html", "url")).alias("pos", "card"))
    return found.select("page_id", "pos", "card.*")
