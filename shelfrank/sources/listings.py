"""Shape of raw listing rows: names, missing cells, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank import rules

LISTING_COLUMNS = ["url", "name", "price", "screen_size", "ssd", "cpu", "ram", "os", "gpu"]
LISTING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LISTING_COLUMNS])


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names."""
    return df.toDF(*[c.lower().strip() for c in df.columns])


def rename_aliases(df: DataFrame) -> DataFrame:
    """Other headers of price and name, taken only where the plain one is absent."""
    if "price" not in df.columns and "fiyat" in df.columns:
        df = df.withColumnRenamed("fiyat", "price")
    if "name" not in df.columns:
        for alias in ("title", "urun"):
            if alias in df.columns:
                return df.withColumnRenamed(alias, "name")
    return df


def null_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens in text columns to null."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in text if columns is None or c in columns]
    return df.withColumns({c: F.when(~F.col(c).isin(rules.NA_TOKENS), F.col(c)) for c in chosen})


def as_listing(df: DataFrame, *more: str) -> DataFrame:
    """The nine listing columns in order (absent ones are null), and after them the columns asked for."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in LISTING_COLUMNS], *more
    )


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, gaps null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
