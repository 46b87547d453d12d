"""Time the headline queries over whole tables; prints one JSON line.

Each query runs once to warm up code paths and once for the clock, into a sink that discards rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave.plans import load_queries
from logweave.session import build_session

HEADLINE = [
    "error_rate_series", "log_volume", "hourly_stats", "service_health", "top_error_patterns", "recent_errors",
    "feature_matrix", "recent_error_rate", "level_distribution", "search", "search_index", "build_search_index",
    "suggest", "filter_metadata", "error_fingerprint", "template_message", "auto_parse", "parse_json_lines",
    "normalize_entry", "enrich", "moving_avg_anomalies", "ewma_anomalies", "cooldown", "alert_threshold",
    "alert_pattern", "iforest_score", "tfidf_fit", "cluster_messages", "novel_messages", "stream_minute_counters",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = os.environ.get("BENCH_WARM", "1") == "1"
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__sql__files__maxPartitionBytes="4m", spark__sql__files__openCostInBytes="262144")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        for timed in ([False, True] if warm else [True]):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
