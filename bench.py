"""Time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

With BENCH_DETAIL set, a table row per query (seconds, shuffled bytes, shuffles) goes to stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from rosterfold.checks.registry import QUERIES  # noqa: E402
from rosterfold.checks.session import local_session  # noqa: E402
from rosterfold.operators.workspace import clear  # noqa: E402


def shuffled(spark: SparkSession) -> tuple[int, int]:
    """Bytes written to shuffles so far, and the number of stages that wrote any."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    sizes = [stages.apply(n).shuffleWriteBytes() for n in range(stages.size())]
    return sum(sizes), sum(size > 0 for size in sizes)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    detail = os.environ.get("BENCH_DETAIL")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{"spark.ui.retainedStages": "100000"})

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        before = shuffled(spark) if detail else (0, 0)
        taken = [run(name)]
        after = shuffled(spark) if detail else (0, 0)
        taken += [run(name) for _ in range(repeats - 1)]
        times[name] = round(sorted(taken)[repeats // 2], 3)
        note = f" | {after[0] - before[0]} | {after[1] - before[1]}" if detail else ""
        print(f"| {name} | {times[name]}{note} |", file=sys.stderr, flush=True)
    clear(spark)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
