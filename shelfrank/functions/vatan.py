"""Attributes from Vatan product cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.amazon import lira
from shelfrank.functions.text import (
    col, contains_any, first_match, folded, group, groups, matches, once, raw_group, replace, strip, to_double, to_long,
)

# Patterns, sizes and defaults of this shop's cards.
SCREEN_UNIT = r"(\d{2}[\.,]?\d?)\s*(?:inç|inc|inch|\"|'')"
# Group 1 takes every number except one with "nesil" or "gen" in the ten characters before it.
SCREEN_BARE = r"(?=\d)(?:(?:(?<=nesil.{0,5}|gen.{0,7})\d{2}[\.,]?\d?)|(\d{2}[\.,]?\d?))"
STORAGE_TB = [1024, 2048, 4096]
STORAGE_GB = [128, 256, 512, 1024, 2048, 4096]
# Of each list of words, a text that matches the pattern holds one.
VIDEO_MEMORY = [
    r"(?:rtx|gtx|rx|arc|mx)[\w\s\-]*?\b\d+\s*gb",
    r"gddr\d?\s*\d+\s*gb",
    r"\b\d+\s*gb\s*vram\b",
]
VIDEO_WORDS = [["rtx", "gtx", "rx", "arc", "mx"], ["gddr"], ["vram"]]
# Group 1 takes every "N gb" except those right behind (within ten characters) or before a storage word.
MEMORY_SIZE = (
    r"(?=\d)(?:(?:(?<=(?:ssd|ufs|hdd)\s{0,7}|(?:emmc|nvme)\s{0,6}|storage\s{0,3})\d+\s*gb)"
    r"|(\d+)\s*gb(?!\s*(?:ssd|emmc|ufs|nvme|hdd|storage))"
    r"|\d+\s*gb)"
)
PRICE_TAIL = r"\s*\d[\d\.,]{2,}\s*(?:tl|₺)?$"


def text_of(name: Column | str, specs: Column | None = None) -> Column:
    """What the attributes are read from."""
    tail = F.lit("") if specs is None else F.coalesce(specs, F.lit(""))
    return F.concat(col(name), F.lit(" "), tail)


def price(text: Column | str) -> Column:
    number = lira(col(text))
    return F.when(number.between(5000, 500000), number)


def clean_name(name: Column | str) -> Column:
    """Name without a price glued to its end."""
    return strip(replace(col(name), PRICE_TAIL, "", True))


def _inches(size: Column) -> Column:
    return to_double(F.replace(size, F.lit(","), F.lit(".")))


def screen(name: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    t = text_of(name, specs) if text is None else text
    unit = _inches(group(t, SCREEN_UNIT, 1, True))
    bare = F.filter(
        F.transform(F.regexp_extract_all(t, F.lit(f"(?is){SCREEN_BARE}"), F.lit(1)), _inches),
        lambda x: x.between(13.0, 19.5),
    )
    size = F.coalesce(F.when(unit.between(10.0, 19.5), unit), F.get(bare, F.lit(0)), F.lit(15.6))
    return F.concat(size.cast("string"), F.lit('"'))


def storage(name: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    t = text_of(name, specs) if text is None else text
    tb = F.try_multiply(to_long(group(t, r"(\d+)\s*TB", 1, True)), F.lit(1024))
    ssd = to_long(group(t, r"(\d+)\s*GB\s*(?:SSD|NVMe)", 1, True))
    gb = to_long(group(t, r"(\d+)\s*GB", 1, True))
    size = F.coalesce(
        F.when(tb.isin(STORAGE_TB), tb),
        F.when(ssd.isin(STORAGE_GB), ssd),
        F.when(gb == 1000, F.lit(1024)).when(gb == 500, F.lit(512)).when(gb.isin(STORAGE_GB), gb),
        F.lit(512),
    )
    return F.concat(size.cast("bigint").cast("string"), F.lit("GB"))


def _without(pattern: str, words: list[str]):
    return lambda t: F.when(contains_any(t, words), replace(t, pattern, " ")).otherwise(t)


def memory(name: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    """Largest size of 4..192 GB that is neither video memory nor storage."""
    t = F.lower(text_of(name, specs) if text is None else text)
    # One pattern after the other, and only on the texts that hold its words.
    for pattern, words in zip(VIDEO_MEMORY, VIDEO_WORDS):
        t = once(t, _without(pattern, words))
    sizes = F.filter(F.transform(groups(t, MEMORY_SIZE), to_long), lambda x: x.between(4, 192))
    return F.concat(F.coalesce(F.array_max(sizes), F.lit(8)).cast("string"), F.lit("GB"))


def cpu(name: Column | str, specs: Column | None = None, text: Column | None = None, low: Column | None = None) -> Column:
    t = text_of(name, specs) if text is None else text
    low = folded(t) if low is None else low

    def g(pattern, idx=1):
        return group(t, pattern, idx, True)

    def up(pattern, idx):
        return F.upper(raw_group(t, pattern, idx, True))

    # Model patterns in order.
    core = r"(?:Intel\s+)?Core\s+(i[3579])[-\s]?(\d{4,5})([A-Z]{0,2})\b"
    core_new = r"Core\s+([579])\s+(\d{3})([A-Z]{0,2})\b"
    ultra = r"(?:Core\s+)?Ultra\s+([579])\s+(\d{3})([A-Z]{0,2})\b"
    ryzen = r"(?:AMD\s+)?Ryzen\s+([3579])\s+(\d{4})([A-Z]{0,3})\b"
    ryzen_ai = r"Ryzen\s+AI\s+([379])\s+(\d{3})\b"
    apple = r"\b(M[1-4])(?:\s+(Pro|Max|Ultra))?\b"
    variant = F.coalesce(F.concat(F.lit(" "), F.initcap(g(apple, 2))), F.lit(""))
    def where(word, *parts):
        return F.when(low.contains(word), F.concat(*parts))

    return F.coalesce(
        where("core", F.upper(g(core)), F.lit("-"), g(core, 2), up(core, 3)),
        where("core", F.lit("Intel Core "), g(core_new), F.lit(" "), g(core_new, 2), up(core_new, 3)),
        where("ultra", F.lit("Intel Ultra "), g(ultra), F.lit(" "), g(ultra, 2), up(ultra, 3)),
        where("ryzen", F.lit("Ryzen "), g(ryzen), F.lit(" "), g(ryzen, 2), up(ryzen, 3)),
        where("ryzen", F.lit("Ryzen AI "), g(ryzen_ai), F.lit(" "), g(ryzen_ai, 2)),
        F.when(contains_any(low, ["m1", "m2", "m3", "m4"]), F.concat(F.upper(g(apple)), variant)),
        where("celeron", F.lit("Celeron "), g(r"Celeron\s+([A-Z]?\d{4})\b")),
        where("pentium", F.lit("Pentium "), g(r"Pentium\s+([A-Z]?\d+)\b")),
        where("snapdragon", F.lit("Snapdragon X "), g(r"Snapdragon\s+X\s+([\w\d\-]+)")),
        F.concat(F.lit("Intel "), g(r"\b(N\d{3,4})\b")),
        F.lit("Intel Core i5"),
    )


def os(name: Column | str, specs: Column | None = None, text: Column | None = None) -> Column:
    t = F.lower(text_of(name, specs) if text is None else text)
    return first_match(
        [
            (contains_any(t, ["windows 11", "win11", "w11"]), F.lit("Windows 11")),
            (contains_any(t, ["windows 10", "win10", "w10"]), F.lit("Windows 10")),
            (t.contains("windows"), F.lit("windows")),
            (t.contains("dos"), F.lit("FreeDOS")),
            (contains_any(t, ["macbook", "macos", "mac os"]), F.lit("macOS")),
            (contains_any(t, ["linux", "ubuntu"]), F.lit("linux")),
            (contains_any(t, ["apple", "mac pro"]), F.lit("macOS")),
        ],
        F.lit("FreeDOS"),
    )


def gpu(name: Column | str, specs: Column | None = None, text: Column | None = None, low: Column | None = None) -> Column:
    t = text_of(name, specs) if text is None else text
    seen = folded(t) if low is None else low
    low = F.lower(t)

    def tagged(prefix, pattern, word=None):
        found = F.concat(F.lit(prefix), group(t, pattern, 1, True))
        return found if word is None else F.when(seen.contains(word), found)

    # Model patterns in order.
    rx_card = r"(?:rx|radeon)\s*([67][0-9]00)([M]?)"
    return F.coalesce(
        tagged("RTX 50", r"rtx\s*50(90|80|70|60|50)", "rtx"),
        tagged("RTX 40", r"rtx\s*40(90|80|70|60|50)", "rtx"),
        tagged("RTX 30", r"rtx\s*30(90|80|70|60|50)", "rtx"),
        tagged("GTX 16", r"gtx\s*16(60|50)", "gtx"),
        tagged("GTX 10", r"gtx\s*10(80|70|60|50)", "gtx"),
        tagged("MX ", r"mx\s*(570|550|450|350|330|250)", "mx"),
        F.when(contains_any(seen, ["rx", "radeon"]), F.concat(tagged("RX ", rx_card), F.upper(raw_group(t, rx_card, 2, True)))),
        F.concat(tagged("Radeon ", r"radeon\s*(\d{3})m", "radeon"), F.lit("M")),
        tagged("Radeon Vega ", r"vega\s*(\d{1,2})", "vega"),
        F.when(seen.contains("arc"), F.concat(F.lit("Intel Arc "), F.upper(group(t, r"arc\s*([a-z]?\d{3,4}m?)", 1, True)))),
        F.when(low.contains("iris xe"), F.lit("Intel Iris Xe")),
        F.when(low.contains("iris plus"), F.lit("Intel Iris Plus")),
        F.when(low.contains("iris"), F.lit("Intel Iris")),
        F.when(contains_any(low, ["uhd", "hd graphics"]), F.lit("Intel UHD")),
        F.when(
            contains_any(low, ["macbook", "mac "]),
            F.concat(F.lit("Apple M"), group(t, r"m([1-4])", 1, True), F.lit(" GPU")),
        ),
        F.lit("Integrated"),
    )
