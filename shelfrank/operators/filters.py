"""Profile-driven predicates over a joined (listing, profile) row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import first_match


def in_budget() -> Column:
    return (F.col("price") >= F.col("min_budget")) & (F.col("price") <= F.col("max_budget"))


def facets() -> Column:
    """Brand and system lists (empty or missing passes), lowest memory and storage, Apple switch."""

    def listed(allowed, value):
        return F.col(allowed).isNull() | (F.size(allowed) == 0) | F.array_contains(F.col(allowed), F.col(value))

    def at_least(limit, value):
        return F.col(limit).isNull() | (F.col(value) >= F.col(limit))

    hidden_apple = (F.col("usage_key") == "gaming") & F.col("exclude_apple_in_gaming") & (F.col("brand") == "apple")
    return (
        listed("allowed_brands", "brand") & listed("allowed_oses", "os")
        & at_least("min_ram", "ram_gb") & at_least("min_ssd", "ssd_gb") & ~hidden_apple
    )


def usage_strict(gpu_cap: Column | None = None) -> Column:
    """The filter of each usage; an unknown usage passes everything.

    Portability has a graphics cap that depends on how many rows are thin enough;
    give it as ``gpu_cap`` once it is known.
    """
    c, usage = F.col, F.col("usage_key")
    thin = c("screen_size") <= 14.5
    dev = (
        (c("ram_gb") >= 16) & (c("cpu_score") >= 6.0) & (c("ssd_gb") >= 256)
        & (c("ram_gb") >= c("dev.min_ram")) & (c("ssd_gb") >= c("dev.min_ssd"))
        & (c("screen_size") <= c("dev.screen_max"))
        & (~(c("dev.need_dgpu") | c("dev.need_cuda")) | c("dgpu"))
        & (~c("dev.need_cuda") | c("cuda"))
    )
    return first_match(
        [
            (usage == "gaming", (c("gpu_score") >= c("min_gpu_score_required")) & (c("ram_gb") >= 8)),
            (usage == "portability", thin if gpu_cap is None else thin & (c("gpu_score") <= gpu_cap)),
            (usage == "productivity", (c("ram_gb") >= 8) & (c("cpu_score") >= 5.0)),
            (usage == "design", (c("ram_gb") >= 16) & (c("gpu_score") >= 4.0) & (c("screen_size") >= 14.0)),
            (usage == "dev", dev),
        ],
        F.lit(True),
    )


def usage_relaxed() -> Column:
    """The filter that takes over when too few rows pass the strict one."""
    c, usage = F.col, F.col("usage_key")
    return first_match(
        [
            (usage == "gaming", c("gpu_score") >= 5.0),
            (usage == "portability", c("screen_size") <= 15.6),
            (usage.isin("design", "dev"), c("ram_gb") >= 12),
        ],
        F.lit(True),
    )


def gaming_gate() -> Column:
    """Second graphics gate of gaming, after the fallback."""
    needed = F.coalesce(F.col("gaming_min_gpu"), F.col("min_gpu_score_required"))
    return (F.col("usage_key") != "gaming") | (F.col("gpu_score") >= needed)
