"""Raw listing cells to typed values. Every function is Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank import rules
from shelfrank.functions.text import (
    col, contains_any, first_keyword, first_match, group, groups, replace, to_double, to_long,
)

NUMERIC_CELL = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _in_price_range(p: Column) -> Column:
    return F.when(p.between(rules.PRICE_MIN, rules.PRICE_MAX), p)


def clean_price(price: Column | str, numeric: Column | bool = False) -> Column:
    """Price text to whole units, null outside 1000..500000.

    Text keeps its digits only. Where ``numeric`` holds the cell comes from a number
    column of its file, so its fraction is cut off instead of read as more digits.
    """
    text = col(price)
    by_digits = _in_price_range(to_long(F.regexp_replace(text, "[^0-9]", "")))
    if numeric is False:
        return by_digits
    by_value = _in_price_range(to_long(to_double(text)))
    if numeric is True:
        return by_value
    return F.when(numeric, by_value).otherwise(by_digits)


def clean_numeric_price(price: Column | str) -> Column:
    """Price that is already a number: fraction cut off, same range."""
    return _in_price_range(to_long(col(price)))


def clean_ram(ram: Column | str) -> Column:
    """Memory in GB: bracketed total, else largest ``N GB``, else a known bare size, else 8."""
    text = F.upper(col(ram))
    first_number = to_long(group(text, r"(\d+)"))
    return F.coalesce(
        to_long(group(text, r"\((\d+)\s*GB\)")),
        F.array_max(F.transform(groups(text, r"(\d+)\s*GB"), to_long)),
        F.when(first_number.isin(rules.RAM_SIZES), first_number),
        F.lit(rules.RAM_DEFAULT).cast("bigint"),
    )


def clean_ssd(storage: Column | str) -> Column:
    """Storage in GB: TB first, then a known GB size, then a known bare size, else 256."""
    text = F.upper(col(storage))
    tb = to_long(group(text, r"(\d+)\s*TB"))
    gb = to_long(group(text, r"(\d+)\s*GB"))
    bare = to_long(group(text, r"(\d+)"))
    return F.coalesce(
        F.try_multiply(tb, F.lit(1024)),
        F.when(gb.isin(rules.SSD_SIZES), gb).when(gb == 1000, F.lit(1024)).when(gb == 500, F.lit(512)),
        F.when(bare.isin(rules.SSD_SIZES), bare).when(bare == 1, F.lit(1024)),
        F.lit(rules.SSD_DEFAULT),
    ).cast("bigint")


def parse_screen(screen: Column | str) -> Column:
    """First number of two digits (and a decimal) between 10 and 19.9; null if there is none."""
    text = F.regexp_replace(F.lower(col(screen)), ",", ".")
    text = replace(text, r"(\d{2})\s*\.\s*(\d)", "$1.$2")
    sizes = F.transform(groups(text, r"(\d{2}(?:\.\d)?)"), to_double)
    return F.get(F.filter(sizes, lambda x: x.between(10.0, 19.9)), F.lit(0))


def extract_brand(name: Column | str) -> Column:
    return F.coalesce(first_keyword(F.lower(col(name)), rules.BRAND_KEYWORDS), F.lit("other"))


def detect_os(os: Column | str, name: Column | str, brand: Column | str) -> Column:
    """Operating system from its own text, then from the product name, then from the brand."""
    return F.coalesce(
        first_keyword(F.lower(col(os)), rules.OS_TEXT_KEYWORDS),
        first_keyword(F.lower(col(name)), rules.OS_NAME_KEYWORDS),
        F.when(col(brand) == "apple", F.lit("macos")),
        F.lit("freedos"),
    )


def is_noise_title(title: Column | str) -> Column:
    """Rows the shop marked as to be deleted; a missing title is not noise."""
    return F.coalesce(col(title).rlike("(?iu)ürün silinecek"), F.lit(False))


def stock_status(hints: Column | str) -> Column:
    """Stock state from delivery and stock texts (array or one text); out of stock wins."""
    blob = col(hints)
    return first_match(
        [
            (blob.rlike("(?iu)tükendi|stokta yok"), F.lit("out_of_stock")),
            (blob.rlike("(?iu)stokta|aynı gün|hızlı kargo|kargoya verilir"), F.lit("in_stock")),
        ],
        F.lit("unknown"),
    )


def title_blob(*parts: Column | str) -> Column:
    """Title first (kept even if empty), then the parts that are set, joined by `` | ``."""
    head, *rest = [col(p) for p in parts]
    return F.concat_ws(" | ", F.coalesce(head, F.lit("")), *[F.nullif(p, F.lit("")) for p in rest])


def is_blocked_page(html: Column | str) -> Column:
    """Empty pages and bot checks."""
    text = F.lower(col(html))
    # Texts of a robot check.
    signs = [
        "captcha", "bot check", "automated access", "unusual traffic", "verify you are a human",
        "güvenlik kontrolü", "doğrulama", "/errors/validatecaptcha", "enter the characters you see below",
    ]
    return text.isNull() | (text == "") | contains_any(text, signs)
