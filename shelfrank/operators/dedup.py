"""Duplicate removal that keeps the first row in sequence order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], seq: str = "seq", null_keys: str = "collapse") -> DataFrame:
    """First row by ``seq`` of each key.

    Rows with a missing key are equal to each other, so they collapse to one; with
    ``null_keys="keep"`` they all stay. The rank filter is pushed below the shuffle by
    Spark, so a key with very many rows sends one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(seq)
    ranked = lambda d: d.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    if null_keys == "collapse":
        return ranked(df)
    if null_keys != "keep":
        raise ValueError(f"null_keys: {null_keys!r}")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return ranked(df.where(~missing)).unionByName(df.where(missing))
