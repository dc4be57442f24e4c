"""Order by score and pick a brand-diverse top N per profile (numbered ``pno``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PROFILE = "pno"


def _best_first():
    return [F.desc("score"), F.asc("price"), F.asc("seq")]


def _key():
    """Ascending sort key of the ranking."""
    return F.struct((-F.col("score")).alias("s"), F.col("price").alias("p"), F.col("seq").alias("q"))


def rank_all(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """``rank`` per profile; with a limit only that many rows of each profile leave a task."""
    w = Window.partitionBy(PROFILE).orderBy(*_best_first())
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rank_in_ranges(scored: DataFrame, folder: str) -> DataFrame:
    """``rank`` of every row of every profile, for profiles that may hold most of the rows.

    Rows are sorted by ranges of (profile, order), so one profile lies in many tasks. A row's
    rank is its place in its range, less where its profile begins there, plus the
    profile's rows in earlier ranges. The sorted rows are written to ``folder`` once, since
    ranges that are drawn anew may have other bounds.
    """
    order = [F.col(PROFILE).asc_nulls_first(), *_best_first()]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = scored.sparkSession.read.parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(PROFILE, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(PROFILE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumnsRenamed({PROFILE: "_profile", "_part": "_run"})
    same = (rows["_part"] == runs["_run"]) & rows[PROFILE].eqNullSafe(runs["_profile"])
    joined = rows.join(runs, same)
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")
    return joined.withColumn("rank", rank).drop("_at", "_part", "_n", "_first", "_before", "_profile", "_run")


def diverse_top(scored: DataFrame, max_top_n: int, few_profiles: bool) -> DataFrame:
    """The brand-diverse top ``top_n`` of each profile, with ``rank``.

    Places 1 and 2 go to the best two rows. Place 3 goes to the best row of a brand not
    among them; rows passed over on the way are out. The places after it go to the rows
    that follow. Without such a third brand the result ends after place 2.

    The third row is the best of the per-brand best rows, so two rows per brand and
    profile settle where the result continues, and a second pass ranks the rows up to
    place 2 and from the third row on. Both passes cut their groups down before the
    shuffle. ``max_top_n`` is the largest ``top_n`` there is; ``few_profiles`` says one
    row per profile is small enough to send to every task.
    """
    per_brand = Window.partitionBy(PROFILE, "brand").orderBy(*_best_first())
    heads = scored.select(PROFILE, "brand", "score", "price", "seq")
    heads = heads.withColumn("_b", F.row_number().over(per_brand)).where("_b <= 2").drop("_b")

    profile = Window.partitionBy(PROFILE)
    heads = heads.withColumns({"_r": F.row_number().over(profile.orderBy(*_best_first())), "_key": _key()})
    heads = heads.withColumn("_taken", F.collect_set(F.when(F.col("_r") <= 2, F.col("brand"))).over(profile))
    bounds = heads.groupBy(PROFILE).agg(
        F.max(F.when(F.col("_r") <= 2, F.col("_key"))).alias("_second"),
        F.min(F.when(~F.array_contains("_taken", F.col("brand")), F.col("_key"))).alias("_third"),
    )
    kept = scored.join(F.broadcast(bounds) if few_profiles else bounds, PROFILE)
    kept = kept.where((_key() <= F.col("_second")) | (_key() >= F.col("_third"))).drop("_second", "_third")
    return rank_all(kept, max(max_top_n, 1)).where(F.col("rank") <= F.greatest(F.col("top_n"), F.lit(1)))


def brand_heads(scored: DataFrame, size: int) -> DataFrame:
    """The best ``size`` rows of each profile and brand, numbered ``_b``; no task sends more of them."""
    per_brand = Window.partitionBy(PROFILE, "brand").orderBy(*_best_first())
    return scored.withColumn("_b", F.row_number().over(per_brand)).where(F.col("_b") <= size)


def diverse_top_of_heads(heads: DataFrame, size: int) -> DataFrame:
    """``diverse_top`` out of the best ``size`` rows of each brand (at least as many as any
    ``top_n``), with ``open``: whether a profile's result may need rows beyond them.

    Only the brands of places 1 and 2 can lack rows: those between place 2 and the third
    brand are passed over, so a brand whose rows all end before the last place of the
    result, and that has more of them, leaves its profile open.
    """
    profile = Window.partitionBy(PROFILE)
    in_order = profile.orderBy("_key")
    rows = heads.withColumn("_key", _key()).withColumn("_r", F.row_number().over(in_order))
    rows = rows.withColumn("_taken", F.collect_set(F.when(F.col("_r") <= 2, F.col("brand"))).over(profile))
    taken = F.array_contains("_taken", F.col("brand"))
    rows = rows.withColumn("_third", F.min(F.when(~taken, F.col("_key"))).over(profile))
    kept = (F.col("_r") <= 2) | (F.col("_key") >= F.col("_third"))
    rows = rows.withColumn("rank", F.sum(F.when(kept, 1).otherwise(0)).over(in_order).cast("int"))
    last = F.greatest(F.col("top_n"), F.lit(1))
    rows = rows.withColumn("_last", F.min(F.when(kept & (F.col("rank") == last), F.col("_key"))).over(profile))
    ends_early = (F.col("_b") == size) & taken & F.col("_third").isNotNull() & (F.col("_last").isNull() | (F.col("_key") < F.col("_last")))
    rows = rows.withColumn("open", F.max(ends_early & (F.col("top_n") > 2)).over(profile))
    return rows.where(kept & (F.col("rank") <= last)).drop("_b", "_key", "_r", "_taken", "_third", "_last")


def summarise(recommended: DataFrame) -> DataFrame:
    """Mean score, price range and size of each profile's result."""
    return recommended.groupBy("profile_id").agg(
        F.avg("score").alias("avg_score"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("*").alias("n"),
    )
