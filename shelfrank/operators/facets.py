"""Summaries and choices over the cleaned listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank import rules


def dataset_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def first_rows(df: DataFrame, n: int = 5, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def ram_distribution(df: DataFrame, ram: str = "ram") -> DataFrame:
    """Listings per memory text, in text order."""
    return df.groupBy(ram).agg(F.count("*").alias("n")).orderBy(F.col(ram).asc_nulls_last())


def top_gpus(df: DataFrame, n: int = 10, gpu: str = "gpu", seq: str = "seq") -> DataFrame:
    """Most frequent graphics texts; equal counts in the order they first appear."""
    counts = df.groupBy(gpu).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    return counts.orderBy(F.col("n").desc(), F.col("first_seq")).limit(n)


def price_stats(df: DataFrame, price: str = "price") -> DataFrame:
    return df.agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.avg(price).alias("avg_price")
    )


def brand_choices(df: DataFrame) -> DataFrame:
    return df.select(F.lower("brand").alias("brand")).where("brand is not null").distinct().orderBy("brand")


def os_choices(df: DataFrame) -> DataFrame:
    """Known systems that occur, in their display order."""
    known = df.sparkSession.createDataFrame(list(zip(rules.OS_FACETS, range(1, 5))), "os string, position int")
    found = df.select(F.lower("os").alias("os")).distinct()
    return known.join(found, "os", "left_semi").orderBy("position")


def budget_slider(df: DataFrame) -> DataFrame:
    """Price range and the default upper end, a third of the way up; no row without prices."""
    span = df.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count("price").alias("n_priced"))
    third = F.col("min_price") + F.floor((F.col("max_price") - F.col("min_price")) / 3)
    return span.where("n_priced > 0").withColumn("default_upper", F.greatest(F.col("min_price"), third))
