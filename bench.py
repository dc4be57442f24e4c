"""Headline timings as one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Every query is run in full (its
rows are written to a sink that drops them); its time is the better of two runs, so that
neither JVM start nor code generation is measured.
"""

from __future__ import annotations

import json
import os
import time

from shelfrank.plans import queries as Q
from shelfrank.plans import recommend as R
from shelfrank.plans.prepare import prepare
from shelfrank.session import build_session, shared_folder, ship_package
from shelfrank.sources import driver_tables as D


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", app="bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    ship_package(spark)

    # Input of the pure passes: the listings as a file, so that making them is not measured.
    raw_path = shared_folder(spark, "bench-raw")
    D.listings(spark, folder).write.parquet(raw_path)  # one file per core
    raw = spark.read.parquet(raw_path)
    n = raw.count()

    def prepare_pass():
        return prepare(raw)

    def one_profile():
        wish = {"min_budget": 10000.0, "max_budget": 60000.0, "usage_key": "gaming", "min_gpu_score_required": 6.0}
        return R.recommend_for(Q.listings_store(spark, folder), wish, top_n=5)

    def named(name):
        return lambda: Q.all_queries()[name](spark, folder)

    runs = {"prepare_pass": prepare_pass, "recommend_one_profile": one_profile}
    runs.update({name: named(name) for name in (
        "clean_data", "recommend_batch", "recommend_gaming", "recommend_dev", "usage_fallback_portability", "score_total_design",
        "diverse_topn", "dedup_name_price", "vendor_cpu_amazon", "vendor_ram_vatan", "vendor_gpu_incehesap", "vendor_cpu_mediamarkt",
        "page_listings_vatan", "history_append",
    )})
    times = {}
    for name, run in runs.items():
        best = None
        for _ in range(2):
            start = time.time()
            run().write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_headline_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "listings": n, "cpus": int(cpus),
        "prepare_rows_per_sec": round(n / times["prepare_pass"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
