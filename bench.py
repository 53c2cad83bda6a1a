"""Seconds per headline query on the test tables; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[BENCH_CPUS]``.
Every query is run to the end without bringing rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.registry import queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_UP = "/root/testdata/sf0.001"
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "m18_best_candidates",
    "m19_similar_pairs",
    "m15_vector_or_overlap",
    "m14_best_by_overlap",
    "m01_best_by_rule",
    "m01_rule_score_counts",
    "m05_cascade",
    "m13_thresholds",
    "m13_score_quantiles",
    "io04_upsert_matches",
    "io07_upsert_candidates",
    "j01_candidate_matches",
    "j03_offer_statistics",
    "g01_technical_skills",
    "g15_score_histogram",
    "g19_places",
    "g23_experience_rollups",
    "g29_co_occurrence",
    "g30_search_ranking",
    "n01_running",
    "a01_skill_set",
    "d02_decode",
    "d04_language",
    "s01_new_profiles",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    known = queries()
    # One small run starts the JVM code paths and the Python workers.
    known["m18_best_candidates"](spark, WARM_UP).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
