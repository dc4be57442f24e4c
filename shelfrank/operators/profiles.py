"""Shopper profiles: schema, defaults and the values derived from choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank import rules

_TEXTS = T.ArrayType(T.StringType())
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("min_budget", T.DoubleType()),
        T.StructField("max_budget", T.DoubleType()),
        T.StructField("usage_key", T.StringType()),
        T.StructField("usage_label", T.StringType()),
        T.StructField("dev_mode", T.StringType()),
        T.StructField("productivity_profile", T.StringType()),
        T.StructField("gaming_titles", _TEXTS),
        T.StructField("min_gpu_score_required", T.DoubleType()),
        T.StructField("gaming_min_gpu", T.DoubleType()),
        T.StructField("design_profiles", _TEXTS),
        T.StructField("design_gpu_hint", T.StringType()),
        T.StructField("design_min_ram_hint", T.IntegerType()),
        T.StructField("allowed_brands", _TEXTS),
        T.StructField("allowed_oses", _TEXTS),
        T.StructField("min_ram", T.IntegerType()),
        T.StructField("min_ssd", T.IntegerType()),
        T.StructField("exclude_apple_in_gaming", T.BooleanType()),
        T.StructField("top_n", T.IntegerType()),
        T.StructField("show_breakdown", T.BooleanType()),
    ]
)


def _defaults() -> dict[str, Column]:
    return {
        "min_budget": F.lit(0.0),
        "max_budget": F.lit(float("inf")),
        "usage_key": F.lit("productivity"),
        "usage_label": F.lit(""),
        "dev_mode": F.lit(rules.DEV_MODE_DEFAULT),
        "productivity_profile": F.lit("office"),
        "min_gpu_score_required": F.lit(rules.GAMING_MIN_GPU),
        "exclude_apple_in_gaming": F.lit(False),
        "top_n": F.lit(5),
        "show_breakdown": F.lit(False),
    }


def complete_profiles(profiles: DataFrame) -> DataFrame:
    """All profile columns in order, absent or missing values at their defaults."""
    defaults, out = _defaults(), []
    for f in PROFILE_SCHEMA:
        value = F.col(f.name) if f.name in profiles.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, defaults[f.name])
        out.append(value.alias(f.name))
    return profiles.select(*out)


def title_scores(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.GAMING_TITLE_SCORES.items()), "title string, title_score double")


def add_title_requirement(profiles: DataFrame) -> DataFrame:
    """Graphics score the chosen games need: at least 6.0, else the most demanding title's."""
    table = title_scores(profiles.sparkSession)
    chosen = profiles.select("profile_id", F.explode("gaming_titles").alias("title"))
    needed = (
        chosen.join(F.broadcast(table), "title")  # ten fixed rows
        .groupBy("profile_id").agg(F.max("title_score").alias("_needed"))
    )
    required = F.greatest(F.lit(rules.GAMING_MIN_GPU), F.coalesce(F.col("_needed"), F.lit(rules.GAMING_MIN_GPU)))
    return profiles.join(needed, "profile_id", "left").withColumn("min_gpu_score_required", required).drop("_needed")


def add_design_hints(profiles: DataFrame) -> DataFrame:
    """Graphics and memory hints of the chosen design fields; none chosen means graphic work."""
    fields = F.when(F.size("design_profiles") > 0, F.col("design_profiles")).otherwise(F.array(F.lit("graphic")))

    def has(*names):
        return F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names]))

    return profiles.withColumns(
        {
            "design_gpu_hint": F.when(has("3d"), "high").when(has("video", "cad"), "mid").otherwise("low"),
            "design_min_ram_hint": F.when(has("3d", "video", "cad"), 32).otherwise(16),
        }
    )
