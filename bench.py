"""Headline queries on one machine. Prints one JSON line.

BENCH_SF_DIR   table directory (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tamis.catalog import relations as R  # noqa: E402
from tamis.catalog import results, scans, supply  # noqa: E402
from tamis.operators.matching import compile_rules  # noqa: E402
from tamis.plans.scan import scan_files  # noqa: E402
from tamis.sources.rules import load_rule_set  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


PACK = compile_rules(load_rule_set())


def _whole_pack(relation):
    return lambda spark, d: scan_files(relation(spark, d), PACK).findings


QUERIES = {
    "scan_documents": scans.scan_documents,
    "scan_documents_all_rules": _whole_pack(R.documents),
    "scan_pages_all_rules": _whole_pack(R.pages),
    "scan_conversations": scans.scan_conversations,
    "captures": scans.captures,
    "pattern_not": scans.pattern_not,
    "taint_flow": scans.taint_flow,
    "diff_only": scans.diff_only,
    "suppress_file": scans.suppress_file,
    "inventory_merge": supply.inventory_merge,
    "licence_verdicts": supply.licence_verdicts,
    "typosquat": supply.typosquat,
    "junit_suites": results.junit_suites,
    "cwe_coverage_gap": results.cwe_coverage_gap,
}


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tamis-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def run(spark: SparkSession, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    start = time.perf_counter()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    startup = time.perf_counter() - start
    times = {}
    for name, query in QUERIES.items():
        run(spark, query)  # warm-up: class loading and code generation
        times[name] = round(statistics.median(run(spark, query) for _ in range(RUNS)), 3)
    docs = R.table(spark, SF_DIR, "documents").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
                "session_start_sec": round(startup, 3),
                "documents_per_sec": round(docs / times["scan_documents"]),
            }
        )
    )


if __name__ == "__main__":
    main()
