"""Times the headline queries: one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["C6_entropy", "C11_vpc", "A9_contact_analysis", "A12_decluster", "V1_variogram_points", "V2_variogram_grid", "E1_krige", "S1_post_sim", "K1_window_mean", "J1_within_distance", "D3_cdf", "J2_knn"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lithospark.more_queries import QUERIES

    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second, warm run counts
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
