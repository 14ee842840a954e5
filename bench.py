"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads. Every query runs
once, in order; then again, in rounds, up to three times in all or until BENCH_SECONDS (default 420) have
gone. A query's figure is the median of its runs. The yardstick is the time of a fixed computation in the
same session, before and after: figures of two machines, or of two hours of one, compare by it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.catalog import QUERIES  # noqa: E402
from barloom.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "top_candidates",
    "consolidate",
    "standardize",
    "label_rank",
    "sliding_windows",
    "score_linear",
    "score_gru",
    "ic_by_date",
    "day_bars",
    "rank",
    "rank_by_score",
    "exit_outcomes",
    "round_trips",
    "mark_equity",
    "settle_cash",
    "baseline_curve",
    "decode_chart_json",
    "stream_upsert",
    "plan_buys",
]
WINDOWED = {"sliding_windows", "score_linear", "score_gru"}


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    with scratch(spark):
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def yardstick(spark) -> float:
    """Seconds to hash and add up a fixed range of numbers."""
    start = time.perf_counter()
    spark.range(400_000_000).selectExpr("sum(hash(id))").write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    until = time.monotonic() + float(os.environ.get("BENCH_SECONDS", "420"))
    spark = local_session(cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    run(spark, HEADLINE[0], sf)  # start the JVM and its workers outside the timings
    yardstick(spark)
    before = yardstick(spark)
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for turn in range(3):
        for name in HEADLINE:
            if turn == 0 or time.monotonic() < until:
                runs[name].append(run(spark, name, sf))
    after = yardstick(spark)
    seconds = {name: round(median(own), 3) for name, own in runs.items()}
    windows = QUERIES["window_counts"](spark, sf).groupBy().sum("windows").first()[0]
    rates = {name: round(windows / seconds[name]) for name in HEADLINE if name in WINDOWED}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "runs": {name: len(own) for name, own in runs.items()},
                "yardstick_sec": [before, after],
                "sf": os.path.basename(sf.rstrip("/")),
                "windows": windows,
                "windows_per_sec": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
