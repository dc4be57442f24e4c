"""Tables written to the shared folder and read again, so that later steps don't compute them anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfrank.session import shared_folder, ship_package

#: Bytes of rows in one batch for a Python worker.
BATCH_BYTES = 4 << 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows as a stored table: lost executors lose none of it, and its plan starts at a scan."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_clustered(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Like ``keep``, in buckets by a column: tables with as many buckets are joined by it without a shuffle.

    Rows that are already dealt out into as many parts by that column give one file a bucket.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    known = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(known)
    return spark.table(known)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as double underscores) for the jobs that run inside."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def small_batches(spark: SparkSession) -> None:
    """Rows are to travel to Python workers some MB at a time, from now on.

    By Spark's default a batch of texts is held as up to 64 MB in the executor and again in the
    worker, for each task. Not taken back: a plan is run after the function that made it ended.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pruned_joins(spark: SparkSession):
    """Joins of a large table with a small filtered one are to drop rows by Spark's own Bloom filter before the shuffle.

    Spark does this by itself for tables above 10 GB; the size of the filter stays limited
    by its settings, and a larger small side is joined without one.
    """
    return settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")


def keep_rows(docs: DataFrame, column: str, wanted: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for whose value in ``column`` the function says so, with all their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(batch.schema.get_field_index(column)))))

    return docs.mapInArrow(run, docs.schema)
