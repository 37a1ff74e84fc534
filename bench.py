"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up (code is compiled, files are opened), then RUNS times; the median counts.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from pressloom.plans import catalog

QUERIES = ["live_feed_top12", "front_page_rank", "run_progress_counts", "value_change_points", "usage_by_step_model", "live_candidates", "event_keys", "page_texts", "exact_copies", "source_quality", "triage_priority", "selection_candidates", "title_similarity_pairs", "quote_evidence", "source_chain", "bulk_update"]
RUNS = 2

if __name__ == "__main__":
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        each = []
        for _ in range(RUNS + 1):
            began = time.time()
            catalog.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(median(each[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
