"""Weighted rendezvous hashing of record keys over shards.

Every shard draws a number for a key from a hash of key and shard; the lowest draw, divided
by the shard's weight, has the record. A draw doesn't depend on the other shards, so a new
shard takes records only into itself and a removed one gives up only its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.session import shared_folder

#: Rows of a shard that are numbered in one task.
ROWS_PER_RUN = 10_000
BITS = 52


def draw(key: Column, shard: int) -> Column:
    """A number above 0 and below 1 for this key and shard, the same on every machine."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << BITS)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a record key. ``weights``: relative size by shard number; a shard of weight 0 gets nothing.

    A null key counts as the empty text. Ties, which a 52-bit draw makes all but
    impossible, go to the smaller shard number.
    """
    live = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
    if not live or any(w < 0 for w in weights.values()):
        raise ValueError("weights must be 0 or more, and one above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.log(draw(text, s)) / F.lit(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in live.items()]
    return F.array_min(F.array(*bids))["shard"]


def even(shards: int) -> dict[int, float]:
    return {s: 1.0 for s in range(shards)}


def number_slots(rows: DataFrame, shard: str, key: str, ties: list[str]) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard, without a gap.

    A shard is cut into runs by a hash of the key, about ROWS_PER_RUN rows each; rows are
    numbered within a run, and a run starts where the runs before it end. The order is run,
    key, ties: equal rows have equal places, whichever comes first.
    """
    largest = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    runs = largest // ROWS_PER_RUN + 1
    from pyspark.sql import Window

    rows = rows.withColumn("_run", F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(runs)))
    sizes = rows.groupBy(shard, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(shard, "_run").orderBy(F.col(key).asc_nulls_first(), *ties)
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, [shard, "_run"])
    return numbered.withColumn("slot", (F.col("_from") + F.col("_at")).cast("long")).drop("_run", "_from", "_at")


def shard_table(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", text: str = "text", grown: Mapping[int, float] | None = None) -> DataFrame:
    """Shard and slot of every row, with its size, and with the shard under the weights ``grown``.

    The text itself is not moved. A null text has no bytes; rows with equal keys share a
    shard; a null key is a key of its own; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_slots(rows, "shard", key, ["size", "text_crc32"])


def write_shards(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", folder: str | None = None) -> str:
    """The records themselves, in one folder a shard (``shard=N``); returns the place.

    Each shard is dealt to several tasks by key, so no task holds a whole shard.
    """
    folder = folder or shared_folder(docs.sparkSession, "shards")
    rows = docs.withColumn("shard", shard_of(F.col(key), weights))
    rows.repartition("shard", F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("shard").parquet(folder)
    return folder
