"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up; the median of the timed runs after that is reported. Results are written to Spark's
no-op sink, so every row is produced and none is moved to Python.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.plans import catalog  # noqa: E402
from newsloom.session import get_session  # noqa: E402

HEADLINE = (
    "interactions_compact", "ingest_articles", "knn_search", "embed_text", "classify_topics", "process_batch",
    "bm25_topk", "semantic_topk", "hybrid_search", "feed", "user_sessions", "latency_percentiles",
)
REPEATS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g"
    )
    queries, seconds = catalog.queries(), {}
    for name in names:
        times = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], [round(t, 2) for t in times], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
