"""Checks rules against their fixtures: fail files must hit, pass files must not."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.language import GENERIC
from tamis.operators.matching import compile_rules, evaluate_pairs
from tamis.sources.small import small_table


def read_fixtures(spark: SparkSession, root: str | Path) -> DataFrame:
    """(rule_id, file_name, text) from ``root``/tests/<rule id>/<file>."""
    base = Path(root) / "tests"
    if not base.is_dir():
        return spark.createDataFrame([], "rule_id string, file_name string, text string")
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(str(base))
    )
    parts = F.split("path", "/", -1)
    return raw.select(
        F.element_at(parts, -2).alias("rule_id"),
        F.element_at(parts, -1).alias("file_name"),
        F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("text"),
    )


def rule_test(fixtures: DataFrame, rules) -> DataFrame:
    """(rule_id, file_name, known, expected, hits, ok). Each fixture meets its
    own rule only; no candidate look-up, no language test."""
    compiled = compile_rules(rules)
    spark = fixtures.sparkSession
    rows = fixtures.select(
        "rule_id",
        F.col("file_name"),
        F.col("text"),
        F.lit(GENERIC).alias("lang"),
    )
    patterns = compiled.small(compiled.pattern_table(spark))
    hits = (
        evaluate_pairs(
            rows.join(patterns, "rule_id"), compiled, every_match=True, scope_flows=False
        )
        .groupBy("rule_id", "file_name")
        .agg(F.count("*").alias("hits"))
    )
    ids = small_table(
        spark, [{"rule_id": i, "known": True} for i in {r.id for r in compiled.rules}],
        "rule_id:string,known:boolean",
    )
    n = F.coalesce("hits", F.lit(0))
    expected = F.when(F.startswith("file_name", F.lit("fail")), "fail").when(
        F.startswith("file_name", F.lit("pass")), "pass"
    )
    return (
        fixtures.select("rule_id", "file_name")
        .join(hits, ["rule_id", "file_name"], "left")
        .join(compiled.small(ids), "rule_id", "left")
        .select(
            "rule_id",
            "file_name",
            F.coalesce("known", F.lit(False)).alias("known"),
            expected.alias("expected"),
            n.alias("hits"),
            F.when(expected == "fail", n > 0)
            .when(expected == "pass", n == 0)
            .otherwise(True)
            .alias("ok"),
        )
    )


def rule_test_totals(results: DataFrame) -> DataFrame:
    """One row: tested, failed, unknown (fixtures without a rule)."""
    known = F.col("known")
    return results.agg(
        F.count(F.when(known, 1)).alias("tested"),
        F.count(F.when(known & ~F.col("ok"), 1)).alias("failed"),
        F.count(F.when(~known, 1)).alias("unknown"),
    )
