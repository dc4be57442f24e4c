"""Connected components of a stored edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.storage import keep


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours under the least of a vertex's neighbourhood: the larger ones, or itself and the smaller ones."""
    if large:
        around = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        joined = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return joined.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex of ``edges`` (long columns u and v).

    Each round is written to the shared folder. Loops (u = v) and repeated edges change
    nothing; a vertex with many neighbours is aggregated before it is moved. An empty table
    gives an empty one.
    """
    pairs = keep(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        pairs = keep(_star(keep(_star(pairs, True), "large"), False), "small")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    # Now every edge leads from a vertex to its component.
    found = pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return found.union(pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
