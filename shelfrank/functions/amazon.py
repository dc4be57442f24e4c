"""Attributes from Amazon result titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import (
    blank, col, contains_any, first_keyword, first_match, folded, group, groups, matches, once, raw_group, replace, strip, to_double,
)

# Patterns, word lists and defaults of this shop's titles.
# Of each list of words next to patterns, a title that matches the pattern holds one.
SCREEN_PATTERNS = [
    r"(\d+[\.,]?\d*)\s*(?:inç|inch|\")",
    r"(\d+[\.,]?\d*)\s*ekran",
    r"(\d+[\.,]?\d*)[\"']",
    r"(\d+[\.,]?\d*)\s*fhd",
    r"(\d+[\.,]?\d*)\s*hd",
]
SCREEN_WORDS = [["in", '"'], ["ekran"], ['"', "'"], ["fhd"], ["hd"]]
STORAGE_PATTERNS = [
    r"(\d+)\s*(gb|tb)\s*(?:ssd|m\.2|nvme|pcie)",
    r"ssd\s*(\d+)\s*(gb|tb)",
    r"(\d+)\s*(gb|tb)\s*(?:depolama|storage)",
]
STORAGE_ANY = r"(\d+)\s*(?:gb|tb)"
STORAGE_NUMBER = r"(\d+)\s*(?:gb|tb)\s*(?:ssd|storage|depolama)"
MEMORY_PATTERNS = [
    r"(\d+)\s*gb\s*(?:ram|ddr|sdram|bellek|memory)",
    r"(\d+)gb\s*ram",
    r"ram\s*(\d+)\s*gb",
    r"(\d+)\s*gb.*bellek",
    r"bellek.*(\d+)\s*gb",
    r"(\d+)\s*gb\s*ddr\d",
    r"(\d+)\s*gb",
]
MEMORY_WORDS = [["ram", "ddr", "bellek", "memory"], ["ram"], ["ram"], ["bellek"], ["bellek"], ["ddr"], ["gb"]]
LARGE_MEMORY_CPUS = ["i7", "i9", "ryzen 7", "ryzen 9", "m2", "m3"]
OS_WORDS = [
    ("freedos", "FreeDOS"), ("free dos", "FreeDOS"), (" dos ", "FreeDOS"),
    ("windows 11", "Windows 11"), ("win11", "Windows 11"), ("w11", "Windows 11"),
    ("windows 10", "Windows 10"), ("win10", "Windows 10"), ("w10", "Windows 10"),
    ("ubuntu", "Ubuntu"), ("linux", "Linux"),
    ("macos", "macOS"), ("mac os", "macOS"),
    ("chrome os", "ChromeOS"), ("chromeos", "ChromeOS"),
]
RTX_MODELS = [
    "5090", "5080", "5070", "5060", "5050", "4090", "4080", "4070", "4060", "4050", "3080", "3070", "3060", "3050",
]
GTX_MODELS = ["1660", "1650"]
GPU_WORDS = [
    *[([f"rtx {m}", f"rtx{m}"], f"rtx {m}") for m in RTX_MODELS],
    *[([f"gtx {m}", f"gtx{m}"], f"gtx {m}") for m in GTX_MODELS],
    ("mx550", "mx550"), ("mx450", "mx450"), ("mx350", "mx350"),
    ("intel uhd", "intel uhd"), ("intel hd", "intel uhd"),
    ("iris xe", "iris xe"), ("iris plus", "iris plus"), ("arc a", "intel arc"),
    ("vega", "amd vega"), ("radeon", "amd radeon"),
    ("uma", "integrated"), ("paylaşımlı", "integrated"), ("integrated", "integrated"), ("dahili", "integrated"),
]
GAMING_WORDS = ["gaming", "oyun", "gamer", "rog", "tuf", "legion", "predator", "nitro"]
APPLE_WORDS = ["apple", "macbook", "imac", "m1", "m2", "m3", "m4"]
GPU_TAGS = [
    ("apple integrated", "apple integrated"), ("integrated", "integrated"), ("dahili", "integrated"),
    ("paylaşımlı", "integrated"), ("intel uhd", "intel uhd"), ("intel hd", "intel uhd"), ("iris xe", "iris xe"),
    ("iris plus", "iris plus"), ("intel arc", "intel arc"), ("amd vega", "amd vega"), ("amd radeon", "amd radeon"),
]


def lira(text: Column) -> Column:
    """Number of a Turkish price text: dot groups thousands, comma marks decimals."""
    num = F.regexp_replace(text, r"[^0-9.,]", "")
    dot, comma = num.contains("."), num.contains(",")
    no_dot = F.replace(num, F.lit("."), F.lit(""))
    decimal = F.replace(no_dot, F.lit(","), F.lit("."))
    last = F.substring_index(num, ",", -1)
    plain = (
        F.when(dot & comma, decimal)
        .when(comma & (F.length(last) == 2), decimal)
        .when(comma, F.replace(num, F.lit(","), F.lit("")))
        .otherwise(no_dot)
    )
    return to_double(plain)


def price(text: Column | str) -> Column:
    """Whole liras, halves to even."""
    return F.bround(lira(col(text)), 0).try_cast("bigint")


def screen(title: Column | str, specs: Column | None = None, low: Column | None = None) -> Column:
    t = col(title)
    low = folded(t) if low is None else low

    def sized(pattern, words):
        size = F.replace(group(t, pattern, 1, True), F.lit(","), F.lit("."))
        return F.when(contains_any(low, words), once(size, lambda s: F.when(to_double(s).between(10.0, 20.0), F.concat(s, F.lit('"')))))

    guess = F.when(contains_any(F.lower(t), ["ultrabook", "air"]), F.lit('13.3"')).otherwise('15.6"')
    return F.coalesce(*[sized(*p) for p in zip(SCREEN_PATTERNS, SCREEN_WORDS)], F.when(blank(t), F.lit('15.6"')).otherwise(guess))


def storage(title: Column | str, specs: Column | None = None) -> Column:
    t = col(title)
    with_unit = [F.concat(group(t, p, 1, True), F.upper(group(t, p, 2, True))) for p in STORAGE_PATTERNS]
    # The widest pattern keeps no unit, so a bare "1 TB" reads as 1GB.
    any_size = F.concat(group(t, STORAGE_ANY, 1, True), F.lit("GB"))
    return F.coalesce(*with_unit, any_size, F.when(blank(t), F.lit("256GB")).otherwise("512GB"))


def cpu(title: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(title))
    cases = []
    for i in ("i9", "i7", "i5", "i3"):
        model = group(t, rf"{i}[\s-]?(\d+)")
        cases += [(model.isNotNull(), F.concat(F.lit(f"{i}-"), model)), (t.contains(f"core {i}"), F.lit(i))]
    for tier in (9, 7, 5, 3):
        model = raw_group(t, rf"ryzen {tier}[\s-]?(\d+)?")
        cases.append((t.contains(f"ryzen {tier}"), F.trim(F.concat(F.lit(f"Ryzen {tier} "), model))))
    cases += [(t.contains(m), F.lit(m.upper())) for m in ("m4", "m3", "m2", "m1")]
    cases += [(t.contains(n), F.lit(f"Celeron {n.upper()}")) for n in ("n100", "n4500", "n4020")]
    for family in ("celeron", "pentium"):
        model = raw_group(t, rf"{family}[\s-]?(\w+)?")
        cases.append((t.contains(family), F.trim(F.concat(F.lit(f"{family.title()} "), model))))
    ultra = group(t, r"ultra[\s-]?([579])")
    cases += [
        (ultra.isNotNull(), F.concat(F.lit("Ultra "), ultra)),
        (contains_any(t, ["apple", "macbook"]), F.lit("M2")),
        (t.contains("amd"), F.lit("Ryzen 5")),
    ]
    return F.when(~blank(t), first_match(cases, F.lit("i5")))


def memory(title: Column | str, specs: Column | None = None, low: Column | None = None) -> Column:
    t = col(title)
    low = folded(t) if low is None else low
    on_disk = groups(F.lower(t), STORAGE_NUMBER, 1, True)

    def sized(pattern, words):
        n = group(t, pattern, 1, True)
        beside = lambda x: F.when(x.isNotNull(), F.when(~F.exists(on_disk, lambda d: d.endswith(x)), F.concat(x, F.lit("GB"))))
        return F.when(low.contains("gb") & contains_any(low, words), once(n, beside))

    large = contains_any(F.lower(cpu(t)), LARGE_MEMORY_CPUS)
    return F.coalesce(*[sized(*p) for p in zip(MEMORY_PATTERNS, MEMORY_WORDS)], F.when(large, F.lit("16GB")).otherwise("8GB"))


def os(title: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(title))
    return F.coalesce(
        first_keyword(t, OS_WORDS),
        F.when(contains_any(cpu(title), ["M1", "M2", "M3", "M4"]), F.lit("macOS")),
        F.when(t.contains("chromebook"), F.lit("ChromeOS")),
        F.lit("FreeDOS"),
    )


def gpu(title: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(title))
    return F.coalesce(
        first_keyword(t, GPU_WORDS),
        F.when(contains_any(t, GAMING_WORDS), F.lit("rtx 3050")),
        F.when(contains_any(t, APPLE_WORDS), F.lit("apple integrated")),
        F.lit("integrated"),
    )


def gpu_tag(gpu_text: Column | str) -> Column:
    """Graphics text to the tag the shop's file holds."""
    t = F.lower(col(gpu_text))
    card = F.replace(group(t, r"((?:rtx|gtx|mx)\s*\d{3,4})"), F.lit(" "), F.lit(""))
    return F.coalesce(first_keyword(t, GPU_TAGS), card, F.lit("integrated"))


def cpu_tag(cpu_text: Column | str) -> Column:
    return F.coalesce(F.replace(strip(F.upper(col(cpu_text))), F.lit("CORE "), F.lit("")), F.lit("i5"))


def os_tag(os_text: Column | str) -> Column:
    t = F.lower(col(os_text))
    return first_match(
        [
            (contains_any(t, ["windows 11", "win11", "w11"]), F.lit("Windows 11")),
            (contains_any(t, ["windows 10", "win10", "w10"]), F.lit("Windows 10")),
            (t.contains("mac"), F.lit("macOS")),
            (contains_any(t, ["linux", "ubuntu", "debian"]), F.lit("Linux")),
            (t.contains("chrome"), F.lit("ChromeOS")),
        ],
        F.lit("FreeDOS"),
    )
