"""Append-only history of listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Who wrote a row: the stream's run, the number of its batch, and which writing of the batch.
RUN, BATCH, WRITING = "run_id", "batch_id", "writing"


def source_of(file_name: Column | str) -> Column:
    """``amazon_laptops.csv`` -> ``amazon``."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.replace(F.regexp_replace(c, r"^.*/|\.csv$", ""), F.lit("_laptops"), F.lit(""))


def stamp(rows: DataFrame, scraped_at: datetime | None = None) -> DataFrame:
    """Adds one time for the whole call, and the source if the rows do not have it."""
    when = F.lit(scraped_at) if scraped_at else F.current_timestamp()
    rows = rows.withColumn("scraped_at", when.cast("timestamp"))
    if "source" not in rows.columns:
        rows = rows.withColumn("source", source_of("source_file"))
    return rows


def append(rows: DataFrame, table: str, scraped_at: datetime | None = None) -> int:
    """Adds the rows to the table at ``table`` and returns how many; older rows are not touched.

    Batch appends and streams share the layout: parts by ``source``, and who wrote a row and
    in which batch as columns (null for a batch append).
    """
    seen = Observation("appended")
    stamped = stamp(rows, scraped_at).observe(seen, F.count(F.lit(1)).alias("n"))
    stamped = stamped.withColumns({RUN: F.lit(None).cast("string"), BATCH: F.lit(None).cast("bigint")})
    stamped.write.mode("append").partitionBy("source").parquet(table)
    return int(seen.get["n"])


def read(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the table, each once.

    A stream's batch that was run again after a failure may have been written twice; its
    last writing counts. Only such batches are looked at twice.
    """
    rows = spark.read.option("mergeSchema", True).parquet(table)
    if WRITING not in rows.columns:
        return rows.drop(RUN, BATCH)
    last = rows.where(F.col(RUN).isNotNull()).groupBy(RUN, BATCH).agg(F.max(WRITING).alias("_last"))
    # A row per batch goes to the rows: one batch may hold most of the table.
    joined = rows.join(F.broadcast(last), [RUN, BATCH], "left")
    return joined.where(F.col(RUN).isNull() | (F.col(WRITING) == F.col("_last"))).drop(RUN, BATCH, WRITING, "_last")


def new_listings(current: DataFrame, history: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose url the history has not seen. A missing url is never seen before.

    Rows without a url are not moved: they can't match and would all meet in one task.
    """
    known = history.select(key).where(F.col(key).isNotNull()).distinct()
    fresh = current.where(F.col(key).isNotNull()).join(known, key, "left_anti")
    return fresh.unionByName(current.where(F.col(key).isNull()))
