"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median counts.
Results go to the ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark

from waybook.catalog import QUERIES
from waybook.session import local_session

HEADLINE = [
    "e1_per_question", "e2_summary", "e14_latency_percentiles", "e22_loose_accuracy", "d1_pending", "d5_with_verdicts",
    "d9_resolved_links", "d10_contaminated", "f1_keep_last", "f2_repeated", "f11_last_per_key", "f14_bad_steps",
    "g2_first_matches", "h2_closed", "i2_boxed_last", "i8_tagged_calls", "i9_channel_calls", "i13_server_calls",
    "i16_html_text", "i18_find_in_page", "j1_native_conversations", "j5_evaluation", "j7_published", "k2_liveness", "k2_worker_lives",
]
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "runs": RUNS, "cpus": cpus,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
