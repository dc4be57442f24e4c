"""Prepared listings stored for many recommendation jobs, with what depends on no profile.

Three tables, published together:

* ``listings``: bucketed by url and sorted by price inside a bucket, so duplicate removal
  by url needs no shuffle of listings and a budget skips row groups;
* ``cells``: how many listings have which price and hardware;
* ``running``: for each hardware and price step, how many listings are cheaper than the step;
* ``shared``: urls whose offers have duplicates under other urls, bucketed like the listings.

Rows without a url and those of very frequent urls are dealt to buckets by their ``seq``, so
one url, or none, may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.sources.snapshot import publish, published, state_key

#: Hardware that the counts of a filter look at.
COUNT_COLUMNS = ["brand", "os", "screen_size", "ram_gb", "ssd_gb", "cpu_score", "gpu_score", "dgpu", "cuda"]
PRICE_STEP, LAST_STEP = 5000, 100  # the last step is open-ended
# Offers of one url above which they are not gathered in one task.
FREQUENT_URL = 10_000
# Input bytes of a bucket, and how many buckets there are at least and at most. A task holds the
# pairs of a bucket's offers with all profiles, and stored input may be far narrower than they are.
BUCKET_BYTES, FEWEST, MOST = 1 << 20, 8, 50_000


@dataclass(frozen=True)
class ListingStore:
    listings: DataFrame
    cells: DataFrame
    running: DataFrame
    shared: DataFrame


def price_step(price: Column) -> Column:
    top = float(PRICE_STEP * LAST_STEP)
    return F.floor(F.least(F.greatest(price.cast("double"), F.lit(0.0)), F.lit(top)) / PRICE_STEP).cast("int")


def count_cells(listings: DataFrame) -> DataFrame:
    """_step, price, hardware, n: listings of each price and hardware."""
    rows = listings.select("price", *COUNT_COLUMNS).where("price is not null")
    return rows.groupBy(price_step(F.col("price")).alias("_step"), "price", *COUNT_COLUMNS).agg(F.count("*").alias("n"))


def running_counts(cells: DataFrame, steps: Iterable[int] | None = None) -> DataFrame:
    """_step, hardware, n: listings of this hardware below each price step from the first that has some below it.

    ``steps``: the steps that are asked for, if not all.
    """
    per_step = cells.groupBy(*COUNT_COLUMNS, "_step").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*COUNT_COLUMNS).orderBy("_step")  # a row for each price step at most
    per_step = per_step.withColumns({"n": F.sum("n").over(along), "_next": F.coalesce(F.lead("_step").over(along), F.lit(LAST_STEP))})
    per_step = per_step.where(F.col("_step") < LAST_STEP)
    if steps is None:
        found = F.sequence(F.col("_step") + 1, F.col("_next"))
    else:
        asked = F.array(*[F.lit(s) for s in sorted(steps)]).cast("array<int>")
        found = F.filter(asked, lambda s: (s > F.col("_step")) & (s <= F.col("_next")))
    return per_step.withColumn("_step", F.explode(found)).drop("_next")


def offer_keys() -> dict[str, Column]:
    return {"url_hash": F.xxhash64("url"), "name_hash": F.xxhash64("name", "price")}


def shared_urls(keys: DataFrame) -> DataFrame:
    """url_hash of urls one of whose offers has its name and price under another url too, and of frequent ones."""
    spread = keys.groupBy("name_hash").agg(F.min("url_hash").alias("a"), F.max("url_hash").alias("b")).where("a <> b").select("name_hash")
    tied = keys.join(spread, "name_hash", "left_semi").select("url_hash")
    frequent = keys.groupBy("url_hash").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT_URL).select("url_hash")
    return tied.union(frequent).distinct().withColumn("_shared", F.lit(True))


def _clustered(spark: SparkSession, name: str, path: str, ddl: str, by: str, sort: str, buckets: int) -> DataFrame:
    """The files at ``path`` as a table whose buckets the planner knows."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _write_clustered(df: DataFrame, name: str, path: str, by: str, sort: str, buckets: int) -> None:
    """One file for each bucket."""
    spread = df.repartition(buckets, by)
    spread.write.format("parquet").bucketBy(buckets, by).sortBy(sort).option("path", path).option("parquet.block.size", 16 << 20).saveAsTable(name)


def write_store(spark: SparkSession, folder: str, listings: DataFrame, buckets: int) -> dict:
    """Writes the tables of prepared listings with features; returns their manifest."""
    name = "shelfrank_" + folder.rstrip("/").rsplit("-", 1)[-1]
    listings = listings if "url" in listings.columns else listings.withColumn("url", F.lit(None).cast("string"))
    # Only the url column of the input is read for this.
    urls = listings.where("url is not null").groupBy(F.xxhash64("url").alias("url_hash")).agg(F.count("*").alias("n"))
    frequent = urls.where(F.col("n") > FREQUENT_URL).select("url_hash", F.lit(True).alias("_frequent"))
    # One row for each FREQUENT_URL listings at most: sent to all tasks, so that listings are shuffled once, to their buckets.
    rows = listings.withColumns(offer_keys()).join(F.broadcast(frequent), "url_hash", "left")
    own = F.col("url").isNotNull() & F.col("_frequent").isNull()
    rows = rows.withColumn("url_key", F.when(own, F.col("url_hash")).otherwise(F.xxhash64("seq"))).drop("_frequent")
    _write_clustered(rows, f"{name}_listings", f"{folder}/listings", "url_key", "price", buckets)
    kept = spark.table(f"{name}_listings")
    shared = shared_urls(kept.select("url_hash", "name_hash"))
    _write_clustered(shared, f"{name}_shared", f"{folder}/shared", "url_hash", "url_hash", buckets)
    # A folder for each price step, so that a job reads the steps at its budgets' ends alone.
    count_cells(kept).write.partitionBy("_step").parquet(f"{folder}/cells")
    running_counts(spark.read.parquet(f"{folder}/cells")).write.partitionBy("_step").parquet(f"{folder}/running")
    return {"folder": folder, "name": name, "buckets": buckets, "listings": _ddl(kept), "shared": _ddl(shared)}


def open_store(spark: SparkSession, manifest: dict) -> ListingStore:
    """The tables that a manifest names."""
    folder, name, buckets = manifest["folder"], manifest["name"], manifest["buckets"]
    return ListingStore(
        _clustered(spark, f"{name}_listings", f"{folder}/listings", manifest["listings"], "url_key", "price", buckets),
        spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/running"),
        _clustered(spark, f"{name}_shared", f"{folder}/shared", manifest["shared"], "url_hash", "url_hash", buckets),
    )


def bucket_count(state: list[tuple]) -> int:
    """Buckets for input files of this state (path, bytes, time)."""
    return min(max(-(-sum(int(s[1]) for s in state) // BUCKET_BYTES), FEWEST), MOST)


def listing_store(spark: SparkSession, root: str, name: str, state: list[tuple], build: Callable[[], DataFrame]) -> ListingStore:
    """The store of this state of the input, written if no writer has published it yet."""
    base = f"{root.rstrip('/')}/{name}-{state_key(state)}"
    found = published(spark, base) or publish(spark, base, lambda folder: write_store(spark, folder, build(), bucket_count(state)))
    return open_store(spark, found)
