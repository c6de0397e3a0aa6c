"""Findings written by a scan, and results of other tools, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING_RECORD = (
    "rule_id string, severity string, message string, fix string, path string, "
    "language string, line int, col int, snippet string"
)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report: an array of findings, an object with ``results``, or one
    finding per line. Reports written by this engine hold one finding per
    line, so they are read in parallel; other layouts file by file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    one = F.regexp_replace("value", "^,", "")
    by_line = F.startswith(one, F.lit('{"rule_id"'))
    rows = lines.filter(by_line).select(F.from_json(one, FINDING_RECORD).alias("f"))
    # The layout is a matter of each file: those with a finding per line are done.
    done = lines.filter(by_line).select("file").distinct()
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    whole = whole.join(done, "file", "left_anti")
    as_list = F.from_json("value", f"array<struct<{_typed()}>>")
    as_results = F.from_json("value", f"struct<results:array<struct<{_typed()}>>>")["results"]
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    return rows.select("f.*").unionByName(whole.select(F.inline(F.when(is_list, as_list).otherwise(as_results))))


def _typed() -> str:
    return ", ".join(f"{n}:{t}" for n, t in (c.split() for c in FINDING_RECORD.split(", ")))


def read_external_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON output of another scanner, as it is."""
    return spark.read.option("multiLine", True).json(path)
