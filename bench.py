"""Headline queries, one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession

from chronolex.plans import registry

HEADLINES = ["ap_03_effective_law", "wn_01_close_versions", "ap_01_get_article_as_of", "ap_04_parse_citation", "ap_10_anti_avoidance_rate", "gq_01_expand_refs_nodes", "gq_05_risk_neighbours", "gq_06_find_unpatched", "tr_05_tree_diff", "rt_01_keyword_search", "rt_02_vector_search"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[HEADLINES[0]](spark, folder).write.format("noop").mode("overwrite").save()  # the first query also starts Spark
    seconds = {}
    for name in HEADLINES:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
