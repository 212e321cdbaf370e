"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from sedimenta import catalog

HEADLINE = ("g04_neighbors", "a09_edge_merge", "j03_cochange_selfjoin", "g07_impact_closure", "g16_overview", "j12_innermost_interval", "a16_churn", "w02_per_group_limit", "k10_multiset_diff", "r02_vector_knn", "r03_lexical_search", "r06_rank_fusion", "y03_link_building", "c04_line_windows")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES[HEADLINE[0]](spark, folder).collect()  # JVM warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
