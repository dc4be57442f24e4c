"""Raw listings to typed, labelled and scored hardware columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank import rules
from shelfrank.functions import clean as C
from shelfrank.functions import hardware as H
from shelfrank.sources.listings import normalise_headers


def clean_data(raw: DataFrame) -> DataFrame:
    """Cleaned listings; keeps all input columns and drops rows without name or a price above 5000.

    A boolean column ``price_is_number`` marks text prices that come from a number column.
    """
    df = normalise_headers(raw)
    have = set(df.columns)
    if "name" not in have:
        df = df.withColumn("name", F.lit(None).cast("string"))

    price = "price" if "price" in have else "fiyat" if "fiyat" in have else None
    if price is None:
        raise ValueError("listings need a price column")
    if isinstance(df.schema[price].dataType, T.NumericType):
        cleaned_price = C.clean_numeric_price(price)
    else:
        cleaned_price = C.clean_price(price, F.col("price_is_number") if "price_is_number" in have else False)

    ssd = "ssd" if "ssd" in have else "storage" if "storage" in have else None

    def text(c):
        return F.col(c).cast("string")

    screen = C.parse_screen(text("screen_size")) if "screen_size" in have else F.lit(None).cast("double")
    # Price first: rows it rejects need no further parsing.
    df = df.withColumn("price", cleaned_price).where((F.col("price") > rules.PRICE_FLOOR) & F.col("name").isNotNull())
    df = df.withColumns(
        {
            "ram_gb": C.clean_ram(text("ram")) if "ram" in have else F.lit(rules.RAM_DEFAULT).cast("bigint"),
            "ssd_gb": C.clean_ssd(text(ssd)) if ssd else F.lit(rules.SSD_DEFAULT).cast("bigint"),
            "screen_size": F.coalesce(screen, F.lit(rules.SCREEN_DEFAULT)),
            "brand": C.extract_brand("name"),
        }
    )
    os = F.col("os") if "os" in have else F.lit(None).cast("string")
    return df.withColumns(
        {
            "os": C.detect_os(os, "name", "brand"),
            "cpu_score": _score_or("cpu_score", have, rules.CPU_SCORE_DEFAULT),
            "gpu_score": _score_or("gpu_score", have, rules.GPU_SCORE_DEFAULT),
        }
    )


def _score_or(column: str, have: set, default: float):
    if column not in have:
        return F.lit(default)
    return F.coalesce(F.col(column).cast("double"), F.lit(default))


def add_hardware(cleaned: DataFrame) -> DataFrame:
    """Processor score, graphics label, and the graphics score of that label."""
    have = set(cleaned.columns)
    df = cleaned.withColumns(
        {
            "cpu_score": H.cpu_score("cpu") if "cpu" in have else F.lit(rules.CPU_SCORE_DEFAULT),
            "gpu_norm": H.gpu_label("gpu") if "gpu" in have else F.lit("Integrated (generic)"),
        }
    )
    if "gpu" not in have:
        return df.withColumn("gpu_score", F.lit(rules.GPU_SCORE_DEFAULT))
    return df.withColumn("gpu_score", H.gpu_score("gpu_norm"))


def prepare(raw: DataFrame) -> DataFrame:
    df = add_hardware(clean_data(raw))
    return df if "cpu" in df.columns else df.withColumn("cpu", F.lit(None).cast("string"))
