"""Benchmark: run every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (all stages run, nothing is
collected to the driver), ``BENCH_REPEAT`` times (default 3); the per-query figure is the
median, which drops the cold first run. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qualityframe.plans.catalog import QUERIES  # noqa: E402
from qualityframe.session import get_session  # noqa: E402


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(
        f"local[{cpus}]",
        app_name="qualityframe-bench",
        shuffle_partitions=int(cpus),
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    names = only or sorted(QUERIES)
    failed: dict[str, str] = {}
    timings: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        try:
            for _ in range(repeat):
                runs.append(run_once(spark, name, sf_dir))
        except Exception as exc:  # keep benchmarking the others; report the failure
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        # the median discards the cold first run (JIT, footers) when repeat >= 3
        timings[name] = round(statistics.median(runs), 4)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    try:
        sf_value: float | str = float(sf)
    except ValueError:
        sf_value = sf
    print(
        json.dumps(
            {
                "metric": "total_median_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_value,
                "cpus": int(cpus),
                "repeat": repeat,
                "failed": failed,
            }
        )
    )


if __name__ == "__main__":
    main()
