"""Attributes from İncehesap titles and specification texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import (
    blank, col, contains_any, first_match, fold_dotted_i, folded, group, matches, not_empty, strip, tidy, to_double, to_long,
)

# Patterns and names of this shop's texts. Of each list of words next to patterns, a
# text that matches the pattern holds one.
CPU_PATTERNS = [
    r"(i[3579]-?\s?\d{3,5}\w*)",
    r"(Ryzen\s?\d(?:\s?\d)?\s?[\w\-]*)",
    r"(Apple\s?M[1-5]\w*)",
    r"(Core\s?Ultra\s?\d+\w*)",
    r"(Core\s?[357]\s?\d{3}\w*)",
]
CPU_WORDS = [["i3", "i5", "i7", "i9"], ["ryzen"], ["apple"], ["core"], ["core"]]
GPU_PATTERNS = [
    r"(RTX\s?\d{3,4}\w*\s?(?:Ti|Max-Q|SUPER)?)",
    r"(GTX\s?\d{3,4}\w*)",
    r"(Radeon\s?\w+(?:\s?\d{3,4})?)",
    r"(Arc\s?Graphics?)",
    r"(Iris\s?Xe)",
    r"(Apple\s?Integrated)",
    r"(Apple\s?M[1-5]\w*\s?GPU)",
]
GPU_WORDS = [["rtx"], ["gtx"], ["radeon"], ["arc"], ["iris"], ["apple"], ["apple"]]
APPLE_CHIPS = ["apple", "macbook", "m1", "m2", "m3", "m4", "m5"]
OS_PATTERNS = [
    (r"Free\s?DOS", "FreeDOS"),
    (r"Windows\s?11|Win11|\bW11(?:P|Pro)?\b", "Windows 11"),
    (r"Windows\s?10|Win10|\bW10\b", "Windows 10"),
    (r"Mac\s?OS|Sonoma|Ventura|Monterey", "macOS"),
    (r"Ubuntu|Linux", "Linux"),
]
BRAND_NAMES = {
    "MSI": "MSI", "ASUS": "ASUS", "ACER": "Acer", "LENOVO": "Lenovo", "HP": "HP", "HUAWEI": "Huawei",
    "APPLE": "Apple", "DELL": "Dell", "MONSTER": "Monster", "CASPER": "Casper", "HONOR": "Honor",
}


def text_of(title: Column | str, specs: Column | None = None) -> Column:
    """What the attributes are read from."""
    return col(title) if specs is None else F.concat(col(title), F.lit(" | "), F.coalesce(specs, F.lit("")))


def tidy_price(text: Column | str) -> Column:
    """Price text without currency and blanks around it."""
    return strip(F.regexp_replace(col(text), "TL|₺", ""))


def plain_price(t: Column) -> Column:
    """Number text with a point for decimals, from a tidied one."""
    dot, comma = t.contains("."), t.contains(",")
    no_dot = F.replace(t, F.lit("."), F.lit(""))
    parts = F.split(t, ",")
    one_decimal_comma = (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(1))) == 2)
    plain = (
        F.when(dot & comma, F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(comma & one_decimal_comma, F.replace(t, F.lit(","), F.lit(".")))
        .when(comma, F.replace(t, F.lit(","), F.lit("")))
        .otherwise(no_dot)
    )
    return group(plain, r"(\d+(?:\.\d{1,2})?)")


def price_of(plain: Column) -> Column:
    """5000..500000; a number from 10 to below 1000 counts as thousands."""
    number = to_double(plain)
    return F.when(number.between(5000, 500000), number).when((number >= 10) & (number < 1000) & (number * 1000).between(5000, 500000), number * 1000)


def price(text: Column | str) -> Column:
    return price_of(plain_price(tidy_price(text)))


def screen(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    """Inches 10..19.5: a number with a unit, else a decimal number."""
    t = text_of(title, specs) if text is None else text
    size = F.coalesce(
        group(t, r"(\d{2}(?:[.,]\d)?)\s*(?:\"|''|inç|inch)", 1, True), group(t, r"(\d{2}[.,]\d)")
    )
    number = to_double(F.replace(size, F.lit(","), F.lit(".")))
    return F.when(number.between(10.0, 19.5), number)


def storage(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    """GB 64..12288."""
    t = text_of(title, specs) if text is None else text
    size = F.coalesce(
        F.try_multiply(to_long(group(t, r"(\d+)\s*TB", 1, True)), F.lit(1024)),
        to_long(group(t, r"(\d{3,4})\s*GB", 1, True)),
    )
    return F.when(size.between(64, 12288), size)


def memory(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    return to_long(group(text_of(title, specs) if text is None else text, r"(\d+)\s*GB", 1, True))


def _first_found(t: Column, low: Column, patterns: list[str], words_of: list[list[str]]) -> Column:
    return F.coalesce(*[F.when(contains_any(low, words), not_empty(tidy(group(t, p, 1, True)))) for p, words in zip(patterns, words_of)])


def cpu_text(title: Column | str, specs: Column | None = None, text: Column | None = None, low: Column | None = None) -> Column:
    t = fold_dotted_i(text_of(title, specs) if text is None else text)
    return F.coalesce(_first_found(t, folded(t) if low is None else low, CPU_PATTERNS, CPU_WORDS), F.lit(""))


def cpu_family(cpu: Column | str) -> Column:
    """Model to family tag: ``i7``, ``ryzen7``, ``m3``, ``ultra7``, ``core7``; other text as it is."""
    t = fold_dotted_i(F.lower(col(cpu)))
    return F.coalesce(
        F.concat(F.lit("m"), group(t, r"\bm([1-5])\b")),
        F.concat(F.lit("i"), group(t, r"\bi([3579])\b")),
        F.concat(F.lit("ultra"), group(t, r"core\s*ultra\s*(\d+)")),
        F.concat(F.lit("core"), group(t, r"core\s*([357])\s")),
        F.concat(F.lit("ryzen"), group(t, r"ryzen\s*(3|5|7|9)")),
        strip(t),
        F.lit(""),
    )


def cpu(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    return cpu_family(cpu_text(title, specs, text))


def os(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    t = fold_dotted_i(text_of(title, specs) if text is None else text)
    return first_match([(matches(t, p, True), F.lit(v)) for p, v in OS_PATTERNS], F.lit(""))


def gpu_text(title: Column | str, specs: Column | None = None, text: Column | None = None, low: Column | None = None) -> Column:
    t = fold_dotted_i(text_of(title, specs) if text is None else text)
    low = folded(t) if low is None else low
    found = _first_found(t, low, GPU_PATTERNS, GPU_WORDS)
    apple_chip = contains_any(low, APPLE_CHIPS) & matches(t, r"\b(Apple|MacBook|M[1-5])\b", True) & contains_any(found, ["Integrated", "GPU"])
    return F.coalesce(
        F.when(apple_chip, F.lit("Apple Integrated")),
        found,
        F.when(contains_any(low, ["apple", "mac"]) & matches(t, r"\b(Apple|MacBook|Mac)\b", True), F.lit("Apple Integrated")),
        F.lit(""),
    )


def gpu_tag(gpu: Column | str, blob: Column | str) -> Column:
    """Graphics text to a tag without blanks; Apple in title or specs wins."""
    raw, blob = F.lower(F.coalesce(col(gpu), F.lit(""))), col(blob)
    t = fold_dotted_i(raw)
    missing = raw.isin("", "nan", "none")
    apple = F.lit("apple integrated")
    return F.coalesce(
        F.when(missing & matches(blob, r"\b(apple|macbook|mac\s|m[1-5])\b", True), apple),
        F.when(missing, F.lit("integrated")),
        F.when(matches(blob, r"\b(apple|macbook|m[1-5])\b", True) | t.contains("apple"), apple),
        F.concat(F.lit("rtx"), group(t, r"rtx\s*([0-9]{4})")),
        F.concat(F.lit("gtx"), group(t, r"gtx\s*([0-9]{4})")),
        F.concat(F.lit("rx"), group(t, r"rx\s*([0-9]{4}\w*)")),
        F.concat(F.lit("rx"), group(t, r"radeon\s*([0-9]{3,4}\w*)")),
        F.when(t.contains("radeon"), F.lit("integrated")),
        F.when(t.contains("arc"), F.lit("intel arc")),
        F.lit("integrated"),
    )


def gpu(title: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    text = text_of(title, specs) if text is None else text
    return gpu_tag(gpu_text(title, specs, text), text)


def brand_word(title: Column | str) -> Column:
    """First word, unbracketed, in the shop's spelling."""
    t = tidy(col(title))
    word = F.upper(F.regexp_replace(F.substring_index(t, " ", 1), r"^[()\[\]{}]+|[()\[\]{}]+$", ""))
    pieces = F.regexp_extract_all(word, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    titled = F.array_join(F.transform(pieces, lambda x: F.initcap(x)), "")
    return first_match([(word == k, F.lit(v)) for k, v in BRAND_NAMES.items()], titled)


def model_words(title: Column | str) -> Column:
    """Everything behind the first word."""
    t = tidy(col(title))
    return F.trim(F.substring(t, F.length(F.substring_index(t, " ", 1)) + 1, F.length(t)))
