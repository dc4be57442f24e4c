"""Listing files as a stream: append to the history, and keep first sightings only."""

from __future__ import annotations

import hashlib
import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.sources.csv_files import sniff_delimiter
from shelfrank.sources.history import BATCH, RUN, WRITING, source_of
from shelfrank.sources.listings import LISTING_SCHEMA, as_listing, null_missing, rename_aliases, union_by_name

MARK = "\ufeff"


def listing_stream(spark: SparkSession, folder: str, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """CSV files as they arrive, with ``source`` from the file name; for files of one layout.

    Columns are read by position; ``append_files`` reads every file under its own header.
    """
    rows = spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(folder)
    return rows.select("*", source_of(F.col("_metadata.file_name")).alias("source"))


def run_id(checkpoint: str) -> str:
    """The name of the stream that keeps its state there: batch numbers are its own."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _add(batch: DataFrame, table: str, run: str, batch_id: int) -> None:
    """Appends a batch. A repeated one is appended again under a later writing; readers take the last."""
    when = F.col("scraped_at") if "scraped_at" in batch.columns else F.current_timestamp()
    stamped = batch.withColumn("scraped_at", when.cast("timestamp"))
    stamped = stamped.withColumns({RUN: F.lit(run), BATCH: F.lit(batch_id).cast("bigint"), WRITING: F.lit(time.time_ns())})
    stamped.write.mode("append").partitionBy("source").parquet(table)


def append_stream(rows: DataFrame, table: str, checkpoint: str):
    """Adds every new row once to the history table; the returned query ends when the input is read.

    Nothing is ever overwritten, so several streams and batch appends may share a table;
    ``history.read`` gives each row once, whatever was run again.
    """
    run = run_id(checkpoint)
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: _add(batch, table, run, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_files(spark: SparkSession, folder: str, table: str, checkpoint: str, recursive: bool = False, source: Column | None = None):
    """Adds the rows of new CSV files to the history, each file read under its own header and delimiter.

    ``source``: an expression over ``path``; the file's name unless given. The stream delivers lines; a file's header is the line at its start. Quoted line breaks
    are not read as such (see ``read_folder`` with ``multi_line``).
    """
    run = run_id(checkpoint)
    lines = spark.readStream.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv").schema("value string").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def write(batch: DataFrame, batch_id: int):
        at = F.monotonically_increasing_id()
        batch = batch.withColumn("at", at).where("value <> ''")
        heads = batch.where("start = 0").groupBy("path").agg(F.min("at").alias("head"), F.min_by("value", "at").alias("header"))
        # A row per file. The lines stay where they are read: a file's lines never meet in one task.
        heads = heads.persist(StorageLevel.DISK_ONLY)
        parts = []
        for header in [r.header for r in heads.select("header").distinct().collect()]:  # a row per layout
            named = heads.where(F.col("header") == header).select("path", "head")
            rows = batch.join(F.broadcast(named), "path").where("at <> head")
            sep = sniff_delimiter(header)
            names = [n.strip().strip('"').lower() or f"unnamed_{i}" for i, n in enumerate(header.lstrip(MARK).split(sep))]
            schema = ", ".join(f"`{n.replace('`', '')}` string" for n in names)
            cells = rows.select("path", F.from_csv("value", schema, {"sep": sep, "escape": '"'}).alias("c")).select("path", "c.*")
            rows = null_missing(rename_aliases(cells)).withColumn("source", source_of("path") if source is None else source)
            parts.append(as_listing(rows, "source"))
        if parts:
            _add(union_by_name(parts), table, run, batch_id)
        heads.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(rows: DataFrame, key: str = "url", delay: str | None = None) -> DataFrame:
    """First row of each key, for good: a key that has come out never comes again.

    With a ``delay`` the state of a key is dropped after it (and rows later than it are
    lost), for streams whose keys don't come back. Rows without a key are all equal.
    """
    rows = rows.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    if delay is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark([key])


def run_to_table(rows: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs a stream over the input there is and returns its output table."""
    query = (
        rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(table)
