"""Fetched shop pages to the nine listing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions import amazon, incehesap, mediamarkt, vatan
from shelfrank.functions.clean import is_blocked_page, is_noise_title, stock_status, title_blob
from shelfrank.functions.text import blank, fold_dotted_i, folded
from shelfrank.operators.dedup import keep_first
from shelfrank.sources import pages as P
from shelfrank.sources.listings import as_listing

DIALECTS = {"amazon": amazon, "incehesap": incehesap, "mediamarkt": mediamarkt, "vatan": vatan}
LISTING_ATTRIBUTES = {"screen_size": "screen", "ssd": "storage", "ram": "memory", "cpu": "cpu", "os": "os", "gpu": "gpu"}
# Attributes that look for a word of the text before they match a pattern.
FOLDS = {"amazon": ("screen", "memory"), "vatan": ("cpu", "gpu"), "incehesap": ("cpu", "gpu")}


def add_attribute(df: DataFrame, target: str, attribute: str, shop: str, name: str, specs: str | None = None) -> DataFrame:
    """One hardware column read from the title and specification columns."""
    return add_attributes(df, shop, name, specs, {target: attribute})


def add_attributes(
    df: DataFrame, shop: str, name: str, specs: str | None = None, wanted: dict[str, str] = LISTING_ATTRIBUTES
) -> DataFrame:
    """Hardware columns of a listing, read from its title (and specification text).

    Text that many rules look at is put in a column first, so that it is made once per
    row: the joined text, and for one shop the model texts its tags are cut from.
    """
    module, spec = DIALECTS[shop], None if specs is None else F.col(specs)
    folds = FOLDS.get(shop, ())

    def low(attribute):
        return {"low": F.col("_low")} if attribute in folds else {}

    if shop in ("amazon", "mediamarkt"):
        df = df.withColumn("_low", folded(F.col(name))) if folds else df
        return df.withColumns({c: getattr(module, a)(F.col(name), spec, **low(a)) for c, a in wanted.items()}).drop("_low")
    df = df.withColumn("_text", module.text_of(F.col(name), spec))
    text = F.col("_text")
    if shop == "vatan":
        df = df.withColumn("_low", folded(text))
        values = {c: getattr(vatan, a)(name, None, text, **low(a)) for c, a in wanted.items()}
        return df.withColumns(values).drop("_text", "_low")
    df = df.withColumn("_low", folded(fold_dotted_i(text)))
    texts = {"cpu": incehesap.cpu_text, "gpu": incehesap.gpu_text}
    df = df.withColumns({f"_{a}": f(name, None, text, **low(a)) for a, f in texts.items() if a in wanted.values()})
    tags = {"cpu": lambda: incehesap.cpu_family("_cpu"), "gpu": lambda: incehesap.gpu_tag("_gpu", text)}
    values = {c: tags[a]() if a in tags else getattr(incehesap, a)(name, None, text) for c, a in wanted.items()}
    return df.withColumns(values).drop("_text", "_low", "_cpu", "_gpu")


def _position():
    return F.struct("page_id", "pos").alias("seq")


def amazon_listings(pages: DataFrame) -> DataFrame:
    """Result cards that are not sponsored; prices and tags as the shop's file has them."""
    found = add_attributes(P.cards(pages.where(~is_blocked_page("html")), "amazon"), "amazon", "name")
    return as_listing(
        found.withColumns(
            {
                "price": amazon.price("price_text"),
                "gpu": amazon.gpu_tag("gpu"),
                "cpu": amazon.cpu_tag("cpu"),
                "os": amazon.os_tag("os"),
            }
        )
    )


def vatan_listings(pages: DataFrame) -> DataFrame:
    """Cards with a name of 10 characters and a price."""
    found = P.cards(pages, "vatan").withColumn("name", vatan.clean_name("name"))
    found = found.where(F.length("name") >= 10).withColumn("price", vatan.price("price_text")).where("price is not null")
    return as_listing(add_attributes(found, "vatan", "name", "specs"))


def mediamarkt_listings(pages: DataFrame) -> DataFrame:
    """Cards with a name line and a price above 10000, one per name."""
    found = P.cards(pages, "mediamarkt").select("*", _position())
    found = found.withColumns({"name": P.card_name("specs"), "price": P.card_price("specs")})
    found = found.where(F.col("name").isNotNull() & (F.col("price") > 10000))
    # One row per name first: the rest is read for the rows that stay.
    return as_listing(add_attributes(keep_first(found, ["name"]), "mediamarkt", "name", "specs"))


def product_details(pages: DataFrame) -> DataFrame:
    """Detail record of product pages: title, price, stock, brand, model and hardware."""
    d = pages.select("page_id", F.col("url").alias("product_url"), P.detail_fields("html").alias("d"))
    d = d.select("page_id", "product_url", "d.*")
    d = d.withColumn("spec_blob", F.array_join("specs", " | "))
    d = d.withColumn("_text", incehesap.text_of("title", F.col("spec_blob")))
    d = d.withColumn("_low", folded(fold_dotted_i(F.col("_text"))))
    title, text, low = F.col("title"), F.col("_text"), F.col("_low")
    named = F.when(blank(title), F.col("product_url")).otherwise(title)

    def read(function):
        return function("title", None, text)

    return d.select(
        "page_id", "product_url", "title",
        P.first_price(F.col("price_texts")).alias("price_try"),
        stock_status(F.array_join("stock_hints", " ")).alias("stock_status"),
        incehesap.brand_word(named).alias("brand"), incehesap.model_words(named).alias("model"),
        incehesap.cpu_text("title", None, text, low).alias("cpu"), incehesap.gpu_text("title", None, text, low).alias("gpu"),
        read(incehesap.memory).alias("ram_gb"), read(incehesap.storage).alias("storage_gb"),
        read(incehesap.screen).alias("screen_inch"), read(incehesap.os).alias("os"),
    )


def fill_from_cards(details: DataFrame, found: DataFrame) -> DataFrame:
    """Card price and title where the product page has none; cards without a page stay, with what they have.

    One card and one page of each product address: the first card in page order, the page
    with the smallest id.
    """
    details = keep_first(details, ["product_url"], seq="page_id").drop("page_id")
    found = keep_first(found.withColumn("_at", F.struct("page_id", "pos")), ["url"], seq="_at")
    c = found.select(
        F.col("url").alias("product_url"), F.col("name").alias("card_title"),
        incehesap.price("price_text").alias("card_price"), F.struct("page_id", "pos").alias("seq"),
    )
    joined = c.join(details, "product_url", "left")
    no_page = F.col("stock_status").isNull()
    title = F.when(blank(F.col("title")), F.col("card_title")).otherwise(F.col("title"))
    joined = joined.withColumns({"price_try": F.coalesce("price_try", "card_price"), "title": title})
    return joined.withColumns(
        {
            "stock_status": F.coalesce("stock_status", F.lit("unknown")),
            "brand": F.when(no_page, incehesap.brand_word("card_title")).otherwise(F.col("brand")),
            "model": F.when(no_page, incehesap.model_words("card_title")).otherwise(F.col("model")),
            **{c: F.coalesce(c, F.lit("")) for c in ("cpu", "gpu", "os")},
        }
    ).drop("card_title", "card_price")


def incehesap_listings(list_pages: DataFrame, product_pages: DataFrame) -> DataFrame:
    """List cards joined to their product pages, one row per product, noise titles out."""
    found = P.cards(list_pages, "incehesap").where(~blank(F.col("url")))
    rows = fill_from_cards(product_details(product_pages), found).where(~is_noise_title("title"))
    blob = title_blob("title", "cpu", "gpu", "os", "model", "brand")
    return as_listing(
        rows.select(
            F.col("product_url").alias("url"), F.col("title").alias("name"),
            F.col("price_try").try_cast("double").alias("price"),
            F.col("screen_inch").try_cast("double").alias("screen_size"),
            F.col("storage_gb").try_cast("double").alias("ssd"),
            incehesap.cpu_family("cpu").alias("cpu"), F.col("ram_gb").try_cast("double").alias("ram"),
            "os", incehesap.gpu_tag("gpu", blob).alias("gpu"),
        )
    )
