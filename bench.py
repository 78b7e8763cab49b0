"""Headline timings: prints one JSON line.

Every query runs to its last row into a no-op sink, once warm; the median of the repetitions counts. BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEAT and BENCH_ONLY
choose data, cores, repetitions and queries.
"""

from __future__ import annotations

import json
import os
import sys
import statistics
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewise.plans.registry import named_queries
from pagewise.session import build_session
from pagewise.sources.tables import corpus

HEADLINE = (
    "classify_pages",
    "group_pages",
    "index_report",
    "coverage_check",
    "classify_distinct",
    "finance_summary",
    "user_dashboard",
    "paid_accounts",
    "consume_credits",
    "admission_replay",
    "fulfil_payments",
    "refund_apply",
    "ip_daily_usage",
    "pick_line",
    "stream_ip_usage",
    "stream_fulfil",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]
    spark = build_session(
        "pagewise-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = named_queries()
    pages = corpus(spark, folder).count()
    # The first query would otherwise bear the start of the JVM.
    queries[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in only or HEADLINE:
        spent = []
        for _ in range(repeat):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(spent), 3)
    total = round(sum(timings.values()), 3)
    line = {"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": timings, "sf": folder}
    line["pages"] = pages
    for name in ("classify_pages", "group_pages", "index_report"):
        if name in timings:
            line[f"{name}_pages_per_sec"] = round(pages / timings[name])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
