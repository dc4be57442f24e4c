"""Weighted score of one listing for one profile.

What depends on the listing alone is worked out once per listing (:func:`add_features`),
what depends on the profile alone once per profile (:func:`add_profile_constants`). Only
short arithmetic is left for the joined row (:func:`add_score`), which keeps the code
Spark generates for it small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank import rules
from shelfrank.functions.hardware import cpu_suffix, has_cuda, has_dgpu, rtx_tier
from shelfrank.functions.text import col, contains_any, first_match, lookup, matches, sql_map, sql_struct, steps

INF = float("inf")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


# --- per profile ----------------------------------------------------------------


def _by_key(key: str, values: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {key} {cases} ELSE {default} END"


def weights(usage: str = "usage_key") -> Column:
    """Struct of the eight part weights (sum 100) of a usage."""

    def as_struct(row):
        factor = 100.0 / sum(row)
        return sql_struct({p: w * factor for p, w in zip(rules.PARTS, row)})

    return F.expr(_by_key(usage, {u: as_struct(r) for u, r in rules.WEIGHTS.items()}, as_struct(rules.BASE_WEIGHTS)))


def performance_mix(usage: str = "usage_key", productivity_profile: str = "productivity_profile") -> Column:
    """Shares of processor and graphics in the performance part."""

    def as_struct(mix):
        return sql_struct({"cpu": mix[0], "gpu": mix[1]})

    multitask = F.expr(f"{usage} = 'productivity' AND {productivity_profile} = 'multitask'")
    other = {u: as_struct(m) for u, m in rules.PERFORMANCE_MIX.items()}
    return F.when(multitask, F.expr(as_struct(rules.PERFORMANCE_MIX_MULTITASK))).otherwise(
        F.expr(_by_key(usage, other, as_struct(rules.PERFORMANCE_MIX_DEFAULT)))
    )


def brand_purpose(usage: str = "usage_key") -> Column:
    """Map of brand to its points for a usage; null for an unknown usage."""
    tables = {
        u: sql_map({b: float(row[i]) for b, row in rules.BRAND_PURPOSE.items()}) for i, u in enumerate(rules.USAGES)
    }
    return F.expr(_by_key(usage, tables, "NULL"))


def os_factors(usage: str = "usage_key") -> Column:
    """Map of system to its factor for a usage; null where the system does not matter."""
    return F.expr(_by_key(usage, {u: sql_map(t) for u, t in rules.OS_FACTOR.items()}, "NULL"))


def dev_preset(dev_mode: str = "dev_mode") -> Column:
    """Struct of a developer preset; an unknown mode has the general one."""

    def as_struct(name):
        preset = rules.DEV_PRESETS[name]
        fields = {k: v for k, v in preset.items() if not isinstance(v, (dict, list))}
        fields.update({f"port_{i}": b for i, b in enumerate(preset["port_bonus"])})
        return sql_struct(fields)

    return F.expr(_by_key(dev_mode, {m: as_struct(m) for m in rules.DEV_PRESETS}, as_struct(rules.DEV_MODE_DEFAULT)))


def dev_table(field: str, dev_mode: str = "dev_mode") -> Column:
    """Map of a developer preset: ``cpu_bias`` by power class or ``os_factor`` by system."""
    tables = {m: sql_map(p[field]) for m, p in rules.DEV_PRESETS.items()}
    return F.expr(_by_key(dev_mode, tables, tables[rules.DEV_MODE_DEFAULT]))


def add_profile_constants(profiles: DataFrame) -> DataFrame:
    """Weights ``w``, performance mix ``mix``, brand and system points and developer preset ``dev``."""
    return profiles.withColumns(
        {
            "w": weights(),
            "mix": performance_mix(),
            "purpose": brand_purpose(),
            "os_factor": os_factors(),
            "dev": dev_preset(),
            "dev_cpu_bias": dev_table("cpu_bias"),
            "dev_os_factor": dev_table("os_factor"),
        }
    )


# --- per listing and profile -----------------------------------------------------


def price_points(price: Column, low: Column, high: Column) -> Column:
    """0-100: cheap is good, with up to 4 points for the middle of the budget."""
    price, low, high = (c.cast("double") for c in (price, low, high))
    span = high - low
    base = F.when(span > 0, (1 - F.try_divide(price - low, span)) * 100).otherwise(100.0)
    off_middle = F.when(
        span > 0, F.try_divide(F.abs(price - F.try_divide(low + high, F.lit(2.0))), F.try_divide(span, F.lit(2.0)))
    ).otherwise(0.0)
    bonus = (1 - off_middle) * 4
    # An endless budget has no middle, so no bonus.
    bonus = F.when(F.isnan(bonus), 0.0).otherwise(F.greatest(F.lit(0.0), bonus))
    inside = F.least(F.lit(100.0), base * 0.95 + bonus)
    excess = F.when(price < low, F.try_divide(low - price, low)).otherwise(F.try_divide(price - high, high))
    outside = F.greatest(F.lit(0.0), (1 - excess) * 50)
    return F.when(price.between(low, high), inside).otherwise(outside)


def battery_points(cpu: Column, gpu: Column) -> Column:
    """Battery guess 0-100 from processor text and graphics score."""
    text = F.lower(F.coalesce(cpu, F.lit("")))
    ryzen = text.contains("ryzen")
    # Points per power class, first match wins.
    by_cpu = first_match(
        [
            (contains_any(text, ["m1", "m2", "m3", "m4"]), F.lit(30)),
            (matches(text, r"i[3579]-\d+u") | text.endswith("-u"), F.lit(20)),
            (matches(text, r"i[3579]-\d+p") | text.contains("-p"), F.lit(10)),
            (text.contains("hx"), F.lit(-20)),
            (matches(text, r"i[3579]-\d+h(?!x)") | text.endswith("-h") | text.contains(" h "), F.lit(-10)),
            (ryzen & (text.contains(" u") | text.endswith("u")), F.lit(20)),
            (ryzen & text.contains("hs"), F.lit(5)),
            (ryzen & (text.contains(" h") | text.endswith("h")), F.lit(-15)),
            (text.contains("ultra"), F.lit(15)),
        ],
        F.lit(0),
    )
    by_gpu = F.when(gpu < 3, 15).when(gpu > 7, -20).when(gpu > 5, -10).otherwise(0)
    return clamp((by_cpu + by_gpu + 50).cast("double"))


def portability_points(screen: Column, gpu: Column) -> Column:
    by_screen = F.when(screen <= 13, 40).when(screen <= 14, 30).when(screen <= 15, 10).when(screen >= 17, -30).otherwise(-10)
    by_gpu = F.when(gpu < 3, 10).when(gpu > 7, -15).otherwise(0)
    return clamp((by_screen + by_gpu + 50).cast("double"))


def feature_columns() -> dict[str, Column]:
    """Points and flags of a prepared listing."""
    c = F.col
    label = F.lower(F.coalesce(c("gpu_norm"), F.lit("")))
    return {
        "ram_points": steps(c("ram_gb"), rules.RAM_STEPS, rules.RAM_STEP_DEFAULT),
        "ssd_points": steps(c("ssd_gb"), rules.SSD_STEPS, rules.SSD_STEP_DEFAULT),
        "brand_points": lookup(c("brand"), rules.BRAND_SCORES, F.lit(rules.BRAND_SCORE_DEFAULT)) * 10,
        "battery_points": battery_points(c("cpu"), c("gpu_score")),
        "portability_points": portability_points(c("screen_size"), c("gpu_score")),
        "cpu_suffix": cpu_suffix("cpu"),
        "dgpu": has_dgpu("gpu_norm"),
        "cuda": has_cuda("gpu_norm"),
        "rtx_tier": rtx_tier("gpu_norm"),
        "apple_gpu": contains_any(label, ["apple m1", "apple m2", "apple m3", "apple m4"]),
    }


FEATURES = [
    "ram_points", "ssd_points", "brand_points", "battery_points", "portability_points",
    "cpu_suffix", "dgpu", "cuda", "rtx_tier", "apple_gpu",
]


def add_features(listings: DataFrame) -> DataFrame:
    """Adds the features, unless the listings were stored with them."""
    if set(FEATURES) <= set(listings.columns):
        return listings
    return listings.withColumns(feature_columns())


def score_parts() -> dict[str, Column]:
    """The eight weighted parts in their order."""
    c = F.col
    points = {
        "price": price_points(c("price"), c("min_budget"), c("max_budget")),
        "performance": (c("cpu_score") * c("mix.cpu") + c("gpu_score") * c("mix.gpu")) * 10,
        "ram": c("ram_points"),
        "storage": c("ssd_points"),
        "brand": c("brand_points"),
        "brand_purpose": F.coalesce(
            F.try_element_at(c("purpose"), c("brand")), F.lit(float(rules.BRAND_PURPOSE_DEFAULT))
        ),
        "battery": c("battery_points"),
        "portability": c("portability_points"),
    }
    return {name: p * c(f"w.{name}") / 100 for name, p in points.items()}


def dev_fit(mode: Column | str = "dev_mode") -> Column:
    """0-100 fit of a listing to the developer preset in ``dev``."""
    mode, c = col(mode), F.col
    dgpu, tier = c("dgpu"), c("rtx_tier")

    def or_default(x, default):
        x = x.cast("double")
        return F.when(x.isNull() | (x == 0), F.lit(float(default))).otherwise(x)

    ram = F.least(F.lit(1.0), or_default(c("ram_gb"), 8) / c("dev.min_ram")) * 20
    ssd = F.least(F.lit(1.0), or_default(c("ssd_gb"), 256) / c("dev.min_ssd")) * 15
    bias = F.coalesce(F.try_element_at(c("dev_cpu_bias"), c("cpu_suffix")), F.lit(0.0))
    cpu = F.greatest(F.lit(0.0), bias) * 4

    below_tiers = {"ml": F.when(dgpu, rules.DEV_ML_ANY_DGPU).otherwise(0.0)}
    extra = first_match(
        [
            (mode == m, first_match([(tier >= t, F.lit(p)) for t, p in table], below_tiers.get(m, F.lit(0.0))))
            for m, table in rules.DEV_TIER_POINTS.items()
        ]
        + [((mode == m) & dgpu, F.lit(p)) for m, p in rules.DEV_DGPU_PENALTY.items()],
        F.lit(0.0),
    )
    gpu = clamp(F.least(F.lit(1.0), or_default(c("gpu_score"), 3.0) / 8.0) * 20 + extra, 0.0, 25.0)

    screen = or_default(c("screen_size"), 15.6)
    bonus = (
        F.when(screen <= 13.6, c("dev.port_0")).when(screen <= 14.5, c("dev.port_1"))
        .when(screen <= 15.6, c("dev.port_2")).when(screen > 16, c("dev.port_3")).otherwise(c("dev.port_4"))
    )
    size = F.when(screen <= c("dev.screen_max"), 1.0).otherwise(0.7) * 10 + bonus * 10

    factor = F.coalesce(F.try_element_at(c("dev_os_factor"), c("os")), F.lit(rules.DEV_OS_FACTOR_DEFAULT))
    apple_bonus = F.when(c("apple_gpu") & mode.isin(rules.DEV_APPLE_BONUS_MODES), 3.0).otherwise(0.0)
    fit = clamp(((ram + ssd + cpu + gpu + size) * factor + apple_bonus) / 84.0 * 100)
    missing = (c("dev.need_dgpu") & ~dgpu) | (c("dev.need_cuda") & ~c("cuda"))
    return F.when(missing, 0.0).otherwise(fit)


def breakdown_text(parts: Column | str) -> Column:
    parts = col(parts)
    return F.concat_ws(
        " | ", *[F.concat(F.lit(f"{p}:"), F.format_number(parts.getField(p), 1)) for p in rules.PARTS]
    )


def add_score(rows: DataFrame) -> DataFrame:
    """Adds ``parts`` (struct of the eight parts) and ``score``; rows have listing features and profile constants."""
    rows = rows.withColumn("parts", F.struct(*[e.alias(p) for p, e in score_parts().items()]))
    total = F.col(f"parts.{rules.PARTS[0]}")
    for p in rules.PARTS[1:]:
        total = total + F.col(f"parts.{p}")
    factor = F.coalesce(F.try_element_at(F.col("os_factor"), F.col("os")), F.lit(1.0))
    rows = rows.withColumn("_total", clamp(total * factor))
    blended = clamp(F.col("_total") * 0.7 + dev_fit() * 0.3)
    return rows.withColumn("score", F.when(F.col("usage_key") == "dev", blended).otherwise(F.col("_total"))).drop("_total")
