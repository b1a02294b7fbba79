"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINES = {
    "rasterize": "grid3_rasterize_mean", "wind_rose": "wx6_wind_rose", "overview": "qry5_overview", "rank_mitigations": "mit3_rank_mitigations",
    "neighbor_distance": "prx7_neighbor_distance", "spread_rate": "fire1_spread_rate", "attribution": "att1_attribute_linear", "hand": "hyd6_hand",
}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from perilframe import plans

    took = {}
    for name, query in HEADLINES.items():
        runs = []
        for _ in range(3):
            began = time.time()
            plans.queries()[query](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
