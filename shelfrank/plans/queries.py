"""Every query by name: (session, table folder) -> DataFrame."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank import rules
from shelfrank.functions import amazon, clean, hardware, incehesap, mediamarkt, scoring, vatan
from shelfrank.operators import facets, filters, profiles as prof
from shelfrank.operators.dedup import keep_first
from shelfrank.operators.ranking import diverse_top, rank_all, rank_in_ranges, summarise
from shelfrank.plans import page_listings as PL
from shelfrank.plans import recommend as R
from shelfrank.plans.prepare import clean_data, prepare
from shelfrank.session import shared_folder, shared_root, ship_package, tune
from shelfrank.sources import csv_files, driver_tables as D, history, pages as P
from shelfrank.sources.listing_store import ListingStore, listing_store
from shelfrank.sources.listings import as_listing, union_by_name
from shelfrank.sources.snapshot import input_state
from shelfrank.streaming import history_stream as HS

SHOPS = ["amazon", "incehesap", "mediamarkt", "vatan"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def listings_store(spark, d) -> ListingStore:
    """Prepared listings with their features and what depends on no profile, parsed and written once."""
    state = input_state(spark, f"{d}/orders.parquet")

    def build() -> DataFrame:
        return scoring.add_features(prepare(D.listings(spark, d))).select("seq", *R.OFFER_COLUMNS, *scoring.FEATURES)

    return listing_store(spark, shared_root(spark), "listings", state, build)


def prepared(spark, d) -> DataFrame:
    return listings_store(spark, d).listings


# --- cleaning and hardware -----------------------------------------------------------


def per_listing(columns, spark, d):
    return D.listings(spark, d).select("seq", *[c().alias(n) for n, c in columns.items()])


CELL_QUERIES = {
    "clean_price": {"price": lambda: clean.clean_price("price")},
    "clean_ram": {"ram_gb": lambda: clean.clean_ram("ram")},
    "clean_ssd": {"ssd_gb": lambda: clean.clean_ssd("ssd")},
    "parse_screen": {"screen": lambda: clean.parse_screen("screen_size")},
    "extract_brand": {"brand": lambda: clean.extract_brand("name")},
    "detect_os": {"os": lambda: clean.detect_os("os", "name", clean.extract_brand("name"))},
    "cpu_score": {"cpu_score": lambda: hardware.cpu_score("cpu")},
    "gpu_label": {"gpu_norm": lambda: hardware.gpu_label("gpu")},
    "gpu_score_from_label": {"gpu_score": lambda: hardware.gpu_score(hardware.gpu_label("gpu"))},
    "gpu_score_raw": {"gpu_score": lambda: hardware.gpu_score("gpu")},
    "cpu_suffix": {"suffix": lambda: hardware.cpu_suffix("cpu")},
    "gpu_flags": {
        "dgpu": lambda: hardware.has_dgpu(hardware.gpu_label("gpu")),
        "cuda": lambda: hardware.has_cuda(hardware.gpu_label("gpu")),
        "tier": lambda: hardware.rtx_tier(hardware.gpu_label("gpu")),
    },
    "vendor_tags": {
        "gpu_tag": lambda: amazon.gpu_tag("gpu"),
        "cpu_tag": lambda: amazon.cpu_tag("cpu"),
        "os_tag": lambda: amazon.os_tag("os"),
    },
    "brand_model": {"brand": lambda: incehesap.brand_word("name"), "model": lambda: incehesap.model_words("name")},
    "title_blob": {"blob": lambda: clean.title_blob("name", "cpu", "gpu", "os")},
    "safe_numeric": {"ram": lambda: F.col("ram").try_cast("double"), "ssd": lambda: F.col("ssd").try_cast("double")},
}


def cleaned_listings(spark, d):
    return clean_data(D.listings(spark, d)).select(
        "seq", "url", "name", "price", "ram_gb", "ssd_gb", "screen_size", "brand", "os", "cpu_score", "gpu_score"
    )


def prepared_listings(spark, d):
    return prepare(D.listings(spark, d)).select("seq", "price", "cpu_score", "gpu_norm", "gpu_score")


def vendor(attribute, shop, spark, d):
    t, module = D.titles(spark, d), PL.DIALECTS[shop]
    if attribute == "price":
        return t.select("seq", module.price("price_text").alias("value"))
    return PL.add_attribute(t, "value", attribute, shop, "title", "specs").select("seq", "value")


def hinted_stock(spark, d):
    hints = D.sql_over(spark, d, D.STOCK_HINTS)
    return hints.select("seq", clean.stock_status("hint").alias("status"))


def noise_titles(spark, d):
    return D.sql_over(spark, d, D.NOISE).where(~clean.is_noise_title("title")).select("seq", "title")


def labelled_values(spark, d):
    t = D.sql_over(spark, d, D.LABELLED)
    return t.select("seq", mediamarkt.labelled_value("specs", mediamarkt.OS_LABELS).alias("value"))


# --- tables ------------------------------------------------------------------------


def shop_frames(spark, d):
    """The listings as the four shops deliver them: different columns, one union."""
    rows = D.listings(spark, d)
    frames = [
        rows.where("source = 'amazon'").drop("screen_size"),
        rows.where("source = 'incehesap'").drop("os", "gpu"),
        rows.where("source = 'mediamarkt'").drop("url"),
        rows.where("source = 'vatan'"),
    ]
    return union_by_name(frames)


def union_listings(spark, d):
    return shop_frames(spark, d).select("seq", "source", "url", "name", "price", "screen_size", "os", "gpu")


def listing_schema(spark, d):
    rows = shop_frames(spark, d).drop("os", "cpu")
    return as_listing(rows)


def written_shops(spark, d) -> str:
    """Shop files as the shops deliver them; one shop's prices are plain numbers, one has no rows."""
    folder = shared_folder(spark, "shops")
    rows = D.listings(spark, d).withColumn("seq_no", F.col("seq").cast("string"))
    base = ["seq_no", "url", "name", "price", "screen_size", "ssd", "cpu", "ram", "os", "gpu"]
    layouts = {
        "amazon": (base, ","),
        "incehesap": ([*base[:3], "os", *base[3:8], "gpu"], ";"),
        "mediamarkt": (base, "\t"),
        "vatan": (list(reversed(base)), "|"),
    }
    for shop, (columns, sep) in layouts.items():
        out = rows.where(F.col("source") == shop).select(*columns)
        if shop == "vatan":
            out = out.withColumn("price", F.concat("price", F.lit(" TL"))).withColumnsRenamed({"price": " PRICE ", "name": "Name"})
        csv_files.save_csv(out, f"{folder}/{shop}", sep=sep)
    csv_files.save_csv(rows.limit(0).select(*base).coalesce(1), f"{folder}/empty")
    return folder


def inventory(spark, d):
    """Rows of each shop's files as found, the shop without rows among them."""
    found = csv_files.inventory(spark, written_shops(spark, d), recursive=True)
    shop = F.element_at(F.split("path", "/"), -2).alias("shop")
    return found.groupBy(shop).agg(F.sum("n_rows").alias("n_rows"))


def csv_round_trip(spark, d):
    """Shop files written, found, read back under their own headers, and cleaned."""
    raw = csv_files.read_folder(spark, written_shops(spark, d), recursive=True)
    return clean_data(raw.drop("seq")).select(
        F.col("seq_no").cast("bigint").alias("seq"), "price", "ram_gb", "ssd_gb", "screen_size", "brand", "os"
    )


def dataset_cache(spark, d):
    """Shop files read from the stored copy that the first reading of their folder made."""
    folder, cache = written_shops(spark, d), shared_folder(spark, "cache")
    csv_files.snapshot(spark, folder, cache, recursive=True)
    raw = csv_files.snapshot(spark, folder, cache, recursive=True)
    return clean_data(raw.drop("seq")).select(
        F.col("seq_no").cast("bigint").alias("seq"), "price", "ram_gb", "ssd_gb", "screen_size", "brand", "os"
    )


def append_history(spark, d):
    """One table written by a batch (first half years) and by two streams with states of their own, the
    first of which is run twice; then rows per source."""
    table = shared_folder(spark, "history")
    history.append(D.listings(spark, d).withColumnRenamed("scraped_at", "seen").where("month(seen) <= 6").withColumnRenamed("seen", "day"), table)
    rows, states = orders_stream(spark, d), [shared_folder(spark, "state") for _ in range(2)]
    for months, state in (("between 7 and 9", 0), ("between 7 and 9", 0), ("> 9", 1)):
        HS.append_stream(rows.where(f"month(scraped_at) {months}"), table, states[state]).awaitTermination()
    return history.read(spark, table).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("seq").alias("seq_sum"))


def stream_files(spark, d):
    """Shop files with headers of their own, appended to the history as they are found."""
    folder, table, state = written_shops(spark, d), shared_folder(spark, "history"), shared_folder(spark, "state")
    shop = F.element_at(F.split("path", "/"), -2)
    HS.append_files(spark, folder, table, state, recursive=True, source=shop).awaitTermination()
    sums = [F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in ("url", "name", "price", "cpu")]]
    return history.read(spark, table).groupBy("source").agg(*sums)


def new_listings(spark, d):
    rows = D.listings(spark, d)
    old, current = rows.where("scraped_at < '1998-01-01'"), rows.where("scraped_at >= '1998-01-01'")
    return history.new_listings(current, old).select("seq", "url")


def vendor_dedup(spark, d):
    rows = D.listings(spark, d).where("price is not null")
    return keep_first(rows, ["name"]).select("seq", "name")


# --- profiles and filters --------------------------------------------------------------


def profile_table(usage, spark, d):
    p = D.profiles(spark, d)
    return p if usage is None else p.where(F.col("usage_key") == usage)


def decided(spark, d, usage=None):
    stored, load = R.store_profiles(profile_table(usage, spark, d))
    rule = scoring.add_profile_constants(stored).select(*R.FILTER_COLUMNS)
    store = listings_store(spark, d)
    table = R.decide_filters(R.count_rows(store.cells, store.running, rule, load), rule, load)
    return store.listings, stored.select("pno", "profile_id"), table, load


def budget_filter(spark, d):
    _, names, table, _ = decided(spark, d)
    return table.join(names, "pno").select("profile_id", "n_in", "n_thin", "n_cap5", "n_cap6", "n_strict", "n_pass", "relaxed")


def filtered(usage, fallback, spark, d):
    """Size and checksum of the rows that pass, per profile."""
    rows, names, table, load = decided(spark, d, usage)
    passing = R.passes() if fallback else filters.usage_strict(F.col("gpu_cap"))
    pairs = R.match_profiles(rows, table, filters.facets() & passing, load)
    sums = pairs.groupBy("pno").agg(
        F.count("*").alias("n_rows"), F.sum("seq").alias("seq_sum"), F.min("price").alias("min_price")
    )
    return sums.join(names, "pno").drop("pno")


def part_weights(spark, d):
    p = scoring.add_profile_constants(prof.complete_profiles(D.profiles(spark, d)))
    return p.select("profile_id", *[F.col(f"w.{n}").alias(n) for n in rules.PARTS], "mix.cpu", "mix.gpu")


def own_profile_rows(spark, d):
    """Each listing with the profile of the customer behind it."""
    own = D.sql_over(spark, d, D.OWN_PROFILE, parses=False)
    p = scoring.add_profile_constants(prof.complete_profiles(D.profiles(spark, d)))
    return prepared(spark, d).join(own, "seq").join(p, "profile_id")


def own_scores(spark, d):
    return scoring.add_score(own_profile_rows(spark, d))


def score_parts(spark, d):
    return own_scores(spark, d).select("seq", *[r6(f"parts.{p}").alias(p) for p in rules.PARTS])


def score_breakdowns(spark, d):
    return own_scores(spark, d).select("seq", scoring.breakdown_text("parts").alias("score_breakdown"))


def score_total(usage, spark, d):
    return own_scores(spark, d).where(F.col("usage_key") == usage).select("seq", "profile_id", r6("score").alias("score"))


def dev_fits(mode, spark, d):
    rows = own_profile_rows(spark, d).where(F.col("dev_mode") == mode)
    return rows.select("seq", "profile_id", r6(scoring.dev_fit()).alias("fit"))


# --- ranking ---------------------------------------------------------------------------

REC_COLUMNS = ["profile_id", "rank", "seq", "url", "name", "price", "brand", "os", "score"]


def recommend(usage, spark, d):
    top = R.recommend(listings_store(spark, d), profile_table(usage, spark, d))
    return top.withColumn("score", r6("score")).select(*REC_COLUMNS)


def recommend_summary(spark, d):
    top = R.recommend(listings_store(spark, d), D.profiles(spark, d))
    return summarise(top).withColumn("avg_score", r6("avg_score"))


def diverse(spark, d):
    rows = own_scores(spark, d).withColumn("pno", F.col("profile_id"))
    top_n = D.profiles(spark, d).agg(F.max("top_n")).first()[0]
    return diverse_top(rows, top_n, few_profiles=False).select("profile_id", "rank", "seq", "brand", r6("score").alias("score"))


def plain_top5(spark, d):
    """Best five of each gaming profile by score alone."""
    p = D.profiles(spark, d).where("usage_key = 'gaming'")
    stored, load = R.store_profiles(p)
    constants = scoring.add_profile_constants(stored)
    rule = constants.select(*R.FILTER_COLUMNS)
    store = listings_store(spark, d)
    table = R.decide_filters(R.count_rows(store.cells, store.running, rule, load), rule, load)
    pairs = R.candidates(store.listings, table, load, shared=store.shared)
    scored = R.score_pairs(pairs, constants.select("profile_id", *R.SCORE_COLUMNS), load)
    return rank_all(scored, 5).select("profile_id", "rank", "seq", "price", r6("score").alias("score"))


def dedup_url(spark, d):
    return keep_first(prepared(spark, d), ["url"]).select("seq", "url", "price")


def dedup_name_price(spark, d):
    return keep_first(keep_first(prepared(spark, d), ["url"]), ["name", "price"]).select("seq", "name", "price")


def ranked(spark, d):
    rows = own_scores(spark, d).select(F.col("profile_id").alias("pno"), "score", "price", "seq")
    return rank_in_ranges(rows, shared_folder(spark, "rank")).select(F.col("pno").alias("profile_id"), "rank", "seq", "price")


# --- choices and summaries ----------------------------------------------------------------


def title_requirement(spark, d):
    p = D.profiles(spark, d).withColumn("gaming_titles", F.split(F.expr(D.TITLE_CHOICE), ";"))
    return prof.add_title_requirement(p.drop("min_gpu_score_required")).select("profile_id", "min_gpu_score_required")


def design_hints(spark, d):
    p = D.profiles(spark, d).withColumn("design_profiles", F.split(F.expr(D.DESIGN_CHOICE), ";"))
    return prof.add_design_hints(p).select("profile_id", "design_gpu_hint", "design_min_ram_hint")


def facet(operator, spark, d):
    return operator(prepared(spark, d))


def ram_distribution(spark, d):
    t = D.titles(spark, d).select(vatan.memory("title", F.col("specs")).alias("ram"))
    return facets.ram_distribution(t)


def gpu_top10(spark, d):
    t = D.titles(spark, d).select("seq", vatan.gpu("title", F.col("specs")).alias("gpu"))
    return facets.top_gpus(t)


def price_stats(spark, d):
    t = D.titles(spark, d).select(vatan.price("price_text").alias("price"))
    return facets.price_stats(t).withColumn("avg_price", r6("avg_price"))


def first_five(spark, d):
    return facets.first_rows(prepared(spark, d)).select("seq", "name", "price")


# --- pages ----------------------------------------------------------------------------------


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def page_titles(spark, d):
    ship_package(spark)
    return pages(spark, d).select("page_id", P.page_title("html").alias("title"))


def page_links(spark, d):
    ship_package(spark)
    return P.page_links(pages(spark, d))


def bad_pages(spark, d):
    return pages(spark, d).select("page_id", clean.is_blocked_page("html").alias("blocked"))


def made_pages(kind, spark, d):
    ship_package(spark)
    return D.sql_over(spark, d, D.MADE_PAGES[kind])


def page_prices(spark, d):
    t = made_pages("detail_all", spark, d)
    return t.select("page_id", P.first_price(P.price_texts("html")).alias("price"))


def page_specs(spark, d):
    return PL.product_details(made_pages("detail_all", spark, d))


def card_lines(spark, d):
    t = D.sql_over(spark, d, D.CARD_TEXT)
    return t.select("seq", P.card_name("card").alias("name"), P.card_price("card").alias("price"))


def page_listings(shop, spark, d):
    if shop == "incehesap":
        return PL.incehesap_listings(made_pages("incehesap", spark, d), made_pages("detail", spark, d))
    reader = {"amazon": PL.amazon_listings, "vatan": PL.vatan_listings, "mediamarkt": PL.mediamarkt_listings}[shop]
    return reader(made_pages(shop, spark, d))


# --- streams --------------------------------------------------------------------------------


def orders_stream(spark, d) -> DataFrame:
    """The listings as a stream over the orders table."""
    schema = spark.read.parquet(f"{d}/orders.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    return spark.sql(D.LISTINGS.replace("FROM orders", "FROM {orders}"), orders=source)


def stream_append(spark, d):
    table, state = shared_folder(spark, "history"), shared_folder(spark, "state")
    HS.append_stream(orders_stream(spark, d), table, state).awaitTermination()
    return history.read(spark, table).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("seq").alias("seq_sum"))


def stream_dedup(spark, d):
    """Urls seen at least once, and one row for all listings without one."""
    table, state = shared_folder(spark, "seen"), shared_folder(spark, "state")
    rows = orders_stream(spark, d).select("url", "scraped_at")
    return HS.run_to_table(HS.first_sightings(rows), table, state).select("url")


def all_queries() -> dict:
    q = {name: partial(per_listing, columns) for name, columns in CELL_QUERIES.items()}
    for attribute in ["price", "screen", "storage", "memory", "cpu", "os", "gpu"]:
        label = {"storage": "ssd", "memory": "ram"}.get(attribute, attribute)
        q.update({f"vendor_{label}_{shop}": partial(vendor, attribute, shop) for shop in SHOPS})
    q.update(
        clean_data=cleaned_listings, prepare=prepared_listings, stock_status=hinted_stock, noise_titles=noise_titles,
        labelled_value=labelled_values, union_by_name=union_listings, listing_schema=listing_schema, inventory=inventory,
        csv_round_trip=csv_round_trip, dataset_cache=dataset_cache, history_append=append_history, new_listings_anti=new_listings,
        vendor_dedup=vendor_dedup, budget_filter=budget_filter, weights=part_weights, score_parts=score_parts,
        score_breakdown=score_breakdowns, dedup_url=dedup_url, dedup_name_price=dedup_name_price, rank=ranked,
        gaming_top5_plain=plain_top5, diverse_topn=diverse, recommend_batch=partial(recommend, None),
        rec_summary=recommend_summary, title_requirement=title_requirement, design_hints=design_hints,
        dataset_size=partial(facet, facets.dataset_size), first_rows=first_five,
        facet_brands=partial(facet, facets.brand_choices), facet_os=partial(facet, facets.os_choices),
        budget_slider=partial(facet, facets.budget_slider), ram_distribution=ram_distribution, gpu_top10=gpu_top10,
        price_stats=price_stats, page_titles=page_titles, page_links=page_links, bad_pages=bad_pages,
        page_prices=page_prices, page_specs=page_specs, card_lines=card_lines,
        stream_append=stream_append, stream_dedup=stream_dedup, stream_files=stream_files,
    )
    for usage in rules.USAGES:
        q[f"usage_filter_{usage}"] = partial(filtered, usage, False)
        q[f"usage_fallback_{usage}"] = partial(filtered, usage, True)
        q[f"score_total_{usage}"] = partial(score_total, usage)
        q[f"recommend_{usage}"] = partial(recommend, usage)
    q.update({f"dev_fit_{mode}": partial(dev_fits, mode) for mode in rules.DEV_PRESETS})
    q.update({f"page_listings_{shop}": partial(page_listings, shop) for shop in SHOPS})
    return {name: _tuned(run) for name, run in q.items()}


def _tuned(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    return query
