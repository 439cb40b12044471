"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Every query is run to the
end over its whole tables, its rows going to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "d01_boxed_last",
    "d10_select_answer",
    "e01_equivalent",
    "e02_choice_match",
    "f01_math_acc",
    "f02_math_format",
    "f06_answer_tag_acc",
    "f14_acc_format",
    "x01_score_many_rewards",
    "f17_cap_verify",
    "f20_mm",
    "j04_salvage",
    "c08_messages",
    "g01_accuracy",
    "g02_worst_case_accuracy",
    "g04_qualified_trials",
    "g06_file_summary",
    "g07_sharded_accuracy",
    "a01_jsonl_scan",
    "t01_running_accuracy",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gradeframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        # building plans: no call-site capture per column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from gradeframe.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    # class loading and the first compilation are not what is measured
    QUERIES["b07_truncated_thoughts"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rpartition("sf")[2],
    }))


if __name__ == "__main__":
    main()
