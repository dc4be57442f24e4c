"""Recommendations for a table of profiles over a table of prepared listings.

Up to BROADCAST_PROFILES profiles are read on the driver and become part of the plan; more
are written to the shared folder under a name made from their content. All else is one
lazy plan. What grows with the data:

* the counts that decide filters are differences of running counts by price step and
  hardware, looked up at the two ends of a budget; the two steps that it cuts are counted
  by price. A listing store has both tables, so no listing is read for them;
* profiles meet offers on price steps (equi-join), so only offers in budget are compared,
  and only offers that pass every filter leave the join;
* listings, not pairs, are dealt out by url, so a url's first offer per profile is found
  where the pairs are made. Only offers whose name and price stand under several urls, those
  without a url and those of very frequent urls go through shuffles of pairs, which keep
  one row per group in every task;
* ranking keeps a few rows per profile and brand in every task before anything is shuffled.
  For up to BROADCAST_RESULTS result rows pairs are made once: those rows settle all
  profiles but the ones that they leave open, whose pairs alone are made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.scoring import FEATURES, INF, add_features, add_profile_constants, add_score, breakdown_text
from shelfrank.operators import filters
from shelfrank.operators.dedup import keep_first
from shelfrank.operators.profiles import PROFILE_SCHEMA, complete_profiles
from shelfrank.operators.ranking import brand_heads, diverse_top, diverse_top_of_heads, summarise
from shelfrank.session import shared_root
from shelfrank.sources.listing_store import LAST_STEP, PRICE_STEP, ListingStore, count_cells, offer_keys, price_step, running_counts, shared_urls
from shelfrank.sources.snapshot import publish, published

OFFER_COLUMNS = [
    "url", "name", "price", "brand", "os", "screen_size", "ram_gb", "ssd_gb", "cpu", "cpu_score", "gpu_norm", "gpu_score",
]
FILTER_COLUMNS = [
    "pno", "min_budget", "max_budget", "usage_key", "min_gpu_score_required", "gaming_min_gpu", "allowed_brands",
    "allowed_oses", "min_ram", "min_ssd", "exclude_apple_in_gaming", "dev",
]
# What a (profile, offer) pair carries through duplicate removal: no text but the keys.
PAIR_COLUMNS = [
    "pno", "seq", "url_key", "url", "name_hash", "name", "price", "brand", "os", "screen_size", "ram_gb", "ssd_gb",
    "cpu_score", "gpu_score", *FEATURES,
]
SCORE_COLUMNS = [
    "pno", "min_budget", "max_budget", "usage_key", "dev_mode", "top_n", "w", "mix", "purpose", "os_factor", "dev",
    "dev_cpu_bias", "dev_os_factor",
]
TOP_COLUMNS = ["pno", "rank", "seq", "score"]
RESULT_COLUMNS = ["profile_id", "rank", "seq", *OFFER_COLUMNS, "score", "parts", "score_breakdown"]

# Up to this many profiles (times at most 101 price steps each) are sent to every task.
BROADCAST_PROFILES = 2000
# Up to this many result rows are sent to every task to fetch their offer columns.
BROADCAST_RESULTS = 100_000
# Rows of a price step that meet profiles in one task, where both sides are shuffled.
STEP_ROWS = 200_000
# Best rows of each profile and brand that are looked at first: at least so many, and this many times the largest result.
HEAD_ROWS, HEAD_FACTOR = 32, 4


@dataclass(frozen=True)
class ProfileLoad:
    """Measured size of the profile table."""

    n: int
    max_top_n: int
    low: float
    high: float
    #: Price steps where budgets begin and end, where the profiles were seen one by one.
    ends: frozenset[int] | None = None

    @property
    def looked_up(self) -> set[int] | None:
        """Price steps whose running counts are needed."""
        return None if self.ends is None else {s for e in self.ends for s in (e, e + 1)}

    @property
    def few_results(self) -> bool:
        return self.n * self.max_top_n <= BROADCAST_RESULTS

    @property
    def few(self) -> bool:
        return self.n <= BROADCAST_PROFILES


def measure(profiles: DataFrame) -> ProfileLoad:
    row = profiles.agg(
        F.count("*").alias("n"), F.max("top_n").alias("t"), F.min("min_budget").alias("lo"), F.max("max_budget").alias("hi")
    ).first()
    return ProfileLoad(row.n, row.t or 1, row.lo if row.n else 0.0, row.hi if row.n else 0.0)


def store_profiles(profiles: DataFrame) -> tuple[DataFrame, ProfileLoad]:
    """Complete profiles, numbered ``pno``, in a form that can be read several times; and their size."""
    spark = profiles.sparkSession
    complete = complete_profiles(profiles).where(F.col("profile_id").isNotNull())
    few = complete.limit(BROADCAST_PROFILES + 1).collect()
    if len(few) <= BROADCAST_PROFILES:
        schema = T.StructType([*complete.schema.fields, T.StructField("pno", T.LongType())])
        local = spark.createDataFrame([(*r, i) for i, r in enumerate(few)], schema)
        low, high = min((r.min_budget for r in few), default=0.0), max((r.max_budget for r in few), default=0.0)
        ends = frozenset(step_number(b) for r in few for b in (r.min_budget, r.max_budget) if b is not None)
        return local, ProfileLoad(len(few), max((r.top_n for r in few), default=1) or 1, low, high, ends)
    rows = complete.withColumn("_row", F.xxhash64(*complete.columns))
    content = rows.agg(F.count("*"), F.sum(F.col("_row").cast("decimal(38,0)")), F.bit_xor("_row")).first()
    target = f"{shared_root(spark)}/profiles-{'-'.join(map(str, content))}"
    found = published(spark, target)
    if found is None:

        def write(folder: str) -> dict:
            complete.withColumn("pno", F.monotonically_increasing_id()).write.parquet(f"{folder}/profiles")
            return {"table": f"{folder}/profiles"}

        found = publish(spark, target, write)
    stored = spark.read.parquet(found["table"])
    return stored, measure(stored)


def step_number(price: float) -> int:
    """``price_step`` of a number."""
    return int(min(max(price, 0.0), float(PRICE_STEP * LAST_STEP)) // PRICE_STEP)


def _meet(rows: DataFrame, wide: DataFrame, load: ProfileLoad) -> DataFrame:
    """Rows and profile rows of the same price step."""
    if load.few:
        return rows.join(F.broadcast(wide), "_step")
    # Both sides are shuffled: a price step is cut into parts by its number of rows, and
    # only its own profiles are copied to them.
    parts = rows.groupBy("_step").agg(F.ceil(F.count("*") / STEP_ROWS).cast("int").alias("_parts"))
    parts = F.broadcast(parts)  # a row per price step
    rows = rows.join(parts, "_step").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_parts")
    wide = wide.join(parts, "_step").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return rows.join(wide, ["_step", "_part"]).drop("_part")


def _budget_steps(profiles: DataFrame) -> DataFrame:
    inside = profiles.where(F.col("min_budget") <= F.col("max_budget"))
    return inside.withColumns({"_low": price_step(F.col("min_budget")), "_high": price_step(F.col("max_budget"))})


def match_profiles(rows: DataFrame, profiles: DataFrame, condition: Column, load: ProfileLoad) -> DataFrame:
    """Pairs of a row and a profile whose budget holds its price and that meet the condition."""
    wide = _budget_steps(profiles).withColumn("_step", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    joined = _meet(rows.withColumn("_step", price_step(F.col("price"))), wide, load)
    return joined.where(filters.in_budget() & condition).drop("_step")


def count_rows(cells: DataFrame, running: DataFrame, profiles: DataFrame, load: ProfileLoad) -> DataFrame:
    """Per profile: rows in budget, rows thin enough, rows under each graphics cap, rows passing.

    Steps that lie within a budget are the difference of two running counts, whatever their
    number; in the steps where it begins and ends rows are counted by price.
    """
    steps = _budget_steps(profiles)
    within = steps.where(F.col("_high") - F.col("_low") > 1)
    looked_up = F.array(F.struct(F.col("_high").alias("step"), F.lit(1).alias("sign")), F.struct((F.col("_low") + 1).alias("step"), F.lit(-1).alias("sign")))
    within = within.withColumn("_at", F.explode(looked_up)).withColumns({"_step": F.col("_at.step"), "_sign": F.col("_at.sign")})
    within = within.where(F.col("_step") <= LAST_STEP).drop("_at", "_low", "_high")
    ends = steps.withColumn("_step", F.explode(F.array_distinct(F.array("_low", "_high")))).drop("_low", "_high")
    thin = F.col("screen_size") <= 14.5
    if load.ends is not None:
        cells = cells.where(F.col("_step").isin(*load.ends))
        running = running.where(F.col("_step").isin(*load.looked_up))

    def totals(pairs):
        sum_of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
        return pairs.where(filters.facets()).groupBy("pno").agg(
            F.sum("n").alias("n_in"), sum_of(thin).alias("n_thin"), sum_of(thin & (F.col("gpu_score") <= 5.0)).alias("n_cap5"),
            sum_of(thin & (F.col("gpu_score") <= 6.0)).alias("n_cap6"), sum_of(filters.usage_strict()).alias("n_strict"),
        )

    between = _meet(running, within, load).withColumn("n", F.col("n") * F.col("_sign"))
    both = totals(between).unionByName(totals(_meet(cells, ends, load).where(filters.in_budget())))
    return both.groupBy("pno").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_thin", "n_cap5", "n_cap6", "n_strict")])


def decide_filters(counts: DataFrame, profiles: DataFrame, load: ProfileLoad) -> DataFrame:
    """Adds the graphics cap of portability and whether the relaxed filter takes over."""
    portable = F.col("usage_key") == "portability"
    cap = (
        F.when(portable & (F.col("n_thin") > 50), 5.0).when(portable & (F.col("n_thin") > 30), 6.0).otherwise(INF)
    )
    passing = (
        F.when(portable & (F.col("n_thin") > 50), F.col("n_cap5"))
        .when(portable & (F.col("n_thin") > 30), F.col("n_cap6"))
        .otherwise(F.col("n_strict"))
    )
    joined = profiles.join(F.broadcast(counts) if load.few else counts, "pno")
    return joined.withColumns(
        {"gpu_cap": cap, "n_pass": passing, "relaxed": (passing < 5) & (F.col("n_in") > 5)}
    )


def passes() -> Column:
    """Usage filter with fallback, then the gaming gate, for decided profiles."""
    strict = filters.usage_strict(F.col("gpu_cap"))
    return F.when(F.col("relaxed"), filters.usage_relaxed()).otherwise(strict) & filters.gaming_gate()


def score_pairs(pairs: DataFrame, constants: DataFrame, load: ProfileLoad) -> DataFrame:
    return add_score(pairs.join(F.broadcast(constants) if load.few else constants, "pno"))


def with_features(listings: DataFrame) -> DataFrame:
    """Listings with their profile-free features, which a stored table may have already."""
    return listings if set(FEATURES) <= set(listings.columns) else add_features(listings)


def candidates(offers: DataFrame, decided: DataFrame, load: ProfileLoad, null_urls: str = "collapse", shared: DataFrame | None = None) -> DataFrame:
    """Offers that pass each profile's filters, without duplicates: the first of each url, then of each name and price.

    ``shared``: the table of that name of the store that the offers come from.
    """
    passing = filters.facets() & passes()
    bucketed = shared is not None
    if not bucketed:
        offers = offers.withColumns(offer_keys()).withColumn("url_key", F.col("url_hash"))
        shared = shared_urls(offers.select("url_hash", "name_hash"))
        settled = F.col("url").isNotNull()
    else:
        settled = F.col("url").isNotNull() & (F.col("url_key") == F.col("url_hash"))
    offers = offers.select("url_hash", *[c for c in PAIR_COLUMNS if c != "pno"])
    marked = offers.join(shared.select(F.col("url_hash").alias("url_key"), "_shared"), "url_key", "left")

    # A url that shares nothing: its offers are in one task before they meet the profiles,
    # and the first of them settles both kinds of duplicates there. A store's buckets hold
    # them so already.
    own = marked.where(F.col("_shared").isNull() & settled).drop("_shared", "url_hash")
    own = own if bucketed else own.repartition("url_key")
    own = match_profiles(own, decided, passing, load).select(*PAIR_COLUMNS)
    own = keep_first(own, ["url_key", "pno", "url"])

    rest = marked.where(F.col("_shared").isNotNull() | ~settled).withColumn("url_key", F.col("url_hash")).drop("_shared", "url_hash")
    rest = match_profiles(rest, decided, passing, load).select(*PAIR_COLUMNS)
    # The hashes only lead the sort keys, where they decide almost every comparison.
    rest = keep_first(rest, ["url_key", "pno", "url"], null_keys=null_urls)
    rest = keep_first(rest, ["name_hash", "pno", "name", "price"])
    return own.unionByName(rest).drop("url_key", "url", "name_hash", "name")


def _top_once(scored_of, decided: DataFrame, load: ProfileLoad) -> DataFrame:
    """The diverse top of few results: pairs are made once, and a second time for profiles left open."""
    size = max(HEAD_ROWS, HEAD_FACTOR * load.max_top_n)
    top = diverse_top_of_heads(brand_heads(scored_of(decided), size), size).select(*TOP_COLUMNS, "open")
    rows = top.collect()  # at most BROADCAST_RESULTS
    spark, schema = decided.sparkSession, T.StructType([f for f in top.schema.fields if f.name != "open"])
    found = [tuple(r)[:-1] for r in rows if not r["open"]]
    left = sorted({r.pno for r in rows if r["open"]})
    if left:
        again = decided.join(F.broadcast(spark.createDataFrame([(p,) for p in left], "pno long")), "pno", "left_semi")
        found += [tuple(r) for r in diverse_top(scored_of(again), load.max_top_n, load.few).select(*TOP_COLUMNS).collect()]
    return spark.createDataFrame(found, schema)


def recommend(listings: DataFrame | ListingStore, profiles: DataFrame, null_urls: str = "collapse") -> DataFrame:
    """Ranked recommendations per profile: budget, usage filter with fallback, duplicates out,
    score, brand-diverse top N.

    ``listings`` are prepared listings with a unique, orderable ``seq``, or a store of them.
    ``null_urls="keep"`` lets offers without a url stand for themselves instead of
    collapsing to one.
    """
    store = listings if isinstance(listings, ListingStore) else None
    listings = store.listings if store else listings
    if "url" not in listings.columns:
        listings, null_urls = listings.withColumn("url", F.lit(None).cast("string")), "keep"
    stored, load = store_profiles(profiles)
    constants = add_profile_constants(stored)
    rule = constants.select(*FILTER_COLUMNS)
    # Literal bounds reach the scan of a stored listing table.
    listings = with_features(listings.where((F.col("price") >= load.low) & (F.col("price") <= load.high)))
    cells = store.cells if store else count_cells(listings)
    decided = decide_filters(count_rows(cells, store.running if store else running_counts(cells, load.looked_up), rule, load), rule, load)

    def scored_of(table: DataFrame) -> DataFrame:
        pairs = candidates(listings, table, load, null_urls, store and store.shared)
        scored = score_pairs(pairs, constants.select(*SCORE_COLUMNS), load)
        return scored.select("pno", "seq", "price", "brand", "top_n", "score")

    top = _top_once(scored_of, decided, load) if load.few_results else diverse_top(scored_of(decided), load.max_top_n, load.few).select(*TOP_COLUMNS)
    final = listings.join(F.broadcast(top.drop("score")) if load.few_results else top.drop("score"), "seq")
    # The parts of the score are worked out again for the few rows that won.
    final = score_pairs(final, constants.select("profile_id", *SCORE_COLUMNS), load)
    return final.withColumn("score_breakdown", breakdown_text("parts")).select(*RESULT_COLUMNS)


def recommend_for(listings: DataFrame | ListingStore, preferences: dict, top_n: int | None = None) -> DataFrame:
    """One shopper: a dict of preferences is a one-row profile table."""
    values = {"profile_id": "me", **preferences}
    if top_n is not None:
        values["top_n"] = top_n
    row = tuple(values.get(f.name) for f in PROFILE_SCHEMA)
    spark = (listings.listings if isinstance(listings, ListingStore) else listings).sparkSession
    return recommend(listings, spark.createDataFrame([row], PROFILE_SCHEMA))


def recommendation_summary(recommended: DataFrame) -> DataFrame:
    return summarise(recommended)
