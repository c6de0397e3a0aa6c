"""Licence and look-alike checks of all manifests below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.globs import relative_path
from tamis.operators.inventory import MANIFESTS, inventory, manifest_order
from tamis.operators.licences import (
    is_problem,
    licence_findings,
    licence_line,
    licence_order,
)
from tamis.operators.lookalikes import lookalikes, suspect_line, suspect_order
from tamis.sources.files import from_path
from tamis.sources.policy import load_policy


def collect_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The merged inventory with manifest paths relative to ``root``."""
    files = from_path(spark, root, names=MANIFESTS).filter(manifest_order(F.col("path")).isNotNull())
    rel = F.coalesce(relative_path(F.col("path"), root), F.col("path"))
    return inventory(files.withColumn("path", rel))


def licence_report(
    spark: SparkSession, root: str, policy_file: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(findings in report order, problems)"""
    found = licence_findings(collect_inventory(spark, root), load_policy(root, policy_file))
    return licence_order(found), found.filter(is_problem(F.col("verdict")))


def licence_text(findings: DataFrame) -> DataFrame:
    """Human-readable lines, worst verdict first."""
    line = F.concat(F.lit("  ["), F.col("verdict"), F.lit("] "), licence_line())
    return licence_order(findings).select(line.alias("text"))


def lookalike_report(spark: SparkSession, root: str) -> DataFrame:
    return suspect_order(lookalikes(collect_inventory(spark, root)))


def lookalike_text(suspects: DataFrame) -> DataFrame:
    return suspect_order(suspects).select(
        F.concat(F.col("ecosystem"), F.lit(": "), suspect_line()).alias("text")
    )
