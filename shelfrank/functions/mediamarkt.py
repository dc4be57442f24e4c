"""Attributes from MediaMarkt product cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import (
    col, contains_any, first_match, group, matches, raw_group, replace, strip, to_double, to_long,
)

# Patterns and word lists of this shop's cards.
SCREEN_PATTERNS = [r'(\d{2}[\.,]\d)"', r'(\d{2})"', r"(\d{2}[\.,]\d)\s*(?:inch|inç)"]
OS_LABELS = ["isletim sistemi", "operating system"]


def price(text: Column | str) -> Column:
    t = F.replace(F.replace(col(text), F.lit("TL"), F.lit("")), F.lit("."), F.lit(""))
    number = to_double(F.regexp_replace(F.replace(t, F.lit(","), F.lit(".")), r"[^0-9.]", ""))
    return F.when(number.between(10000, 500000), number)


def screen(name: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(name))
    sizes = [F.concat(F.replace(group(t, p), F.lit(","), F.lit(".")), F.lit('"')) for p in SCREEN_PATTERNS]
    return F.coalesce(*sizes, F.lit('15.6"'))


def storage(name: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(name))
    tb, gb = to_long(group(t, r"(\d+)\s*tb")), to_long(group(t, r"(\d{3,4})\s*gb"))
    size = F.coalesce(F.try_multiply(tb, F.lit(1024)), F.when(gb >= 128, gb), F.lit(512))
    return F.concat(size.cast("string"), F.lit("GB"))


def memory(name: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(name))
    size = F.coalesce(group(t, r"(\d+)\s*gb\s*(?:ram|ddr)"), group(t, r"(\d+)gb"), F.lit("8"))
    return F.concat(size, F.lit("GB"))


def cpu(name: Column | str, specs: Column | None = None) -> Column:
    """Lower-case processor name; null when nothing hints at one."""
    blob = F.lower(F.concat(col(name), F.lit(" "), F.coalesce(specs, F.lit("")) if specs is not None else F.lit("")))

    def two(prefix, pattern, joint=" "):
        first = group(blob, pattern)
        return first, F.trim(F.concat(F.lit(prefix), first, F.lit(joint), raw_group(blob, pattern, 2)))

    apple, apple_name = two("m", r"m(\d)(?:\s*(pro|max|ultra))?")
    snap_x = group(blob, r"snapdragon\s*x\s*(elite|plus|1e[\w\-]*)")
    snap = group(blob, r"snapdragon\s*([\w\-]+)")
    ryzen_ai, ryzen_ai_name = two("ryzen ai ", r"ryzen\s*ai\s*(\d)\s*([\d]{2,4}[a-z]*)?")
    ryzen, ryzen_name = two("ryzen ", r"ryzen\s*([3579])\s*([\d]{3,5}[a-z]*)?")
    ultra, ultra_name = two("ultra ", r"ultra\s*(\d)\s*([\d]{3}[a-z]*)?")
    core, core_name = two("", r"(i[3579])[-\s]*([\d]{4,5}[a-z]*)", "-")
    is_amd = contains_any(blob, ["amd", "ryzen"])
    return first_match(
        [
            ((blob.contains("macbook") | matches(blob, r"\bapple m\d")) & apple.isNotNull(), apple_name),
            (
                contains_any(blob, ["snapdragon", "x elite", "x plus", "x1e"]),
                F.coalesce(
                    F.concat(F.lit("snapdragon x "), snap_x), F.concat(F.lit("snapdragon "), snap), F.lit("snapdragon")
                ),
            ),
            (is_amd & ryzen_ai.isNotNull(), ryzen_ai_name),
            (is_amd & ryzen.isNotNull(), ryzen_name),
            (is_amd, F.lit("ryzen")),
            (ultra.isNotNull(), ultra_name),
            (core.isNotNull(), core_name),
            (contains_any(blob, ["intel", "core"]), F.lit("intel")),
        ]
    )


def os_name(text: Column) -> Column:
    t = F.lower(text)
    return first_match(
        [
            (contains_any(t, ["windows 11", "win11", "w11"]), F.lit("Windows 11")),
            (contains_any(t, ["windows 10", "win10", "w10"]), F.lit("Windows 10")),
            (contains_any(t, ["freedos", "free dos"]), F.lit("FreeDOS")),
            (t.contains("chrome"), F.lit("ChromeOS")),
            (contains_any(t, ["linux", "ubuntu"]), F.lit("Linux")),
            (contains_any(t, ["macos", "mac os", "macbook"]) | matches(t, r"m\d"), F.lit("macOS")),
        ]
    )


def labelled_value(text: Column | str, labels: list[str]) -> Column:
    """Rest of the line after the first label that has something behind it."""

    def after(label):
        rest = F.regexp_extract(col(text), f"(?isu){label}(.*)", 1)
        rest = F.regexp_replace(rest, r"^[ :\-\n\t]+|[ :\-\n\t]+$", "")
        return F.nullif(strip(F.substring_index(rest, "\n", 1)), F.lit(""))

    return F.coalesce(*[after(label) for label in labels])


def os(name: Column | str, specs: Column | None = None) -> Column:
    from_name = os_name(col(name))
    if specs is None:
        return from_name
    return F.coalesce(os_name(labelled_value(specs, OS_LABELS)), from_name)


def gpu_tag(name: Column | str, gpu_text: Column | str) -> Column:
    """Apple devices have one tag whatever the text says."""
    t = F.lower(col(name))
    apple = t.contains("macbook") | matches(t, r"m[12345]")
    return F.when(apple, F.lit("apple integrated")).otherwise(F.lower(col(gpu_text)))


def gpu(name: Column | str, specs: Column | None = None) -> Column:
    t = F.lower(col(name))
    raw = first_match(
        [
            (t.contains("rtx"), F.concat(F.lit("rtx"), F.coalesce(group(t, r"rtx\s*(\d{4})"), F.lit("3050")))),
            (t.contains("gtx"), F.coalesce(F.concat(F.lit("gtx"), group(t, r"gtx\s*(\d{4})")), F.lit("integrated"))),
            (t.contains("iris xe"), F.lit("iris xe")),
            (t.contains("uhd"), F.lit("intel uhd")),
            (t.contains("radeon"), F.lit("amd radeon")),
        ],
        F.lit("integrated"),
    )
    return gpu_tag(name, raw)
