"""Small tables from values that live on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A table of driver values as a constant of the plan: no Python worker
    and no RDD is involved. ``fields`` reads like the fields of a struct type."""
    text = json.dumps(rows, ensure_ascii=False)
    schema = f"array<struct<{fields}>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), schema)))
