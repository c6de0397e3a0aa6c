"""Scanning files as they arrive."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tamis.operators.findings import FINDING_COLUMNS, IGNORE_TOKEN, ORDER_COLUMNS
from tamis.operators.matching import candidate_pairs, compile_rules, evaluate_pairs
from tamis.plans.incremental import content_hash, stored_table
from tamis.plans.scan import raw_findings
from tamis.sources.files import from_table


def text_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    path_col: Column,
    text_col: Column,
    only: str = "*.parquet",
) -> DataFrame:
    """A stream over the Parquet files that appear in a directory. Where the path
    may be one file, it has to be given as a pattern."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(path)
    return from_table(raw, path_col, text_col)


def match_stream(files: DataFrame, rules) -> DataFrame:
    """Hits of a stream of files. Matching keeps no state, so this appends
    without a watermark; hits of several patterns of one rule may repeat."""
    compiled = compile_rules(rules)
    rows = files.select("path", "text", "lang")
    return evaluate_pairs(candidate_pairs(rows, compiled), compiled)


def scan_stream(
    files: DataFrame,
    rules,
    out: str,
    checkpoint: str,
    ignore_tokens: tuple[str, ...] = (IGNORE_TOKEN,),
) -> DataStreamWriter:
    """Writer that stores the findings of every micro-batch under its batch id;
    a repeated batch replaces its own output, so each counts once."""
    compiled = compile_rules(rules)

    def store(batch: DataFrame, batch_id: int) -> None:
        found = raw_findings(batch, compiled, ignore_tokens)
        (
            found.filter("not ignored")
            .select(*FINDING_COLUMNS, *ORDER_COLUMNS, F.lit(batch_id).alias("batch_id"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out)
        )

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def stream_findings(spark: SparkSession, out: str) -> DataFrame:
    """What the batches of ``scan_stream`` found; no rows where they found nothing."""
    return stored_table(spark, out, f"{_FINDING}, batch_id bigint")


_VERSION = ["path", "content_hash", "delivery"]
_SEEN = "path string, content_hash bigint, at bigint, delivery string"
_FINDING = (
    "rule_id string, severity string, path string, line int, col int, message string, snippet string, "
    "language string, fix string, rule_ord int, pat_ord int, match_ord int"
)
_FOUND = f"{_FINDING}, content_hash bigint, delivery string"


def scan_stream_latest(
    files: DataFrame,
    rules,
    out: str,
    checkpoint: str,
    ignore_tokens: tuple[str, ...] = (IGNORE_TOKEN,),
) -> DataStreamWriter:
    """Like ``scan_stream`` for files that may come again, as they were or
    changed. Each batch stores its findings and then the (path, content hash)
    keys that it saw; ``latest_findings`` reads what the last delivery of each
    path gave. The keys are the state: they live in ``out``, not in the
    memory of a stream, and outlast a new checkpoint."""
    compiled = compile_rules(rules)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        def put(rows: DataFrame, name: str) -> None:
            (
                rows.withColumn("delivery", F.lit(f"{stream}-{batch_id}"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("delivery")
                .parquet(f"{out}/{name}")
            )

        now = F.lit(time.time_ns() // 1000)
        keyed = batch.withColumn("content_hash", content_hash())
        found = raw_findings(keyed, compiled, ignore_tokens, carry=("content_hash",))
        columns = (*FINDING_COLUMNS, *ORDER_COLUMNS, "content_hash")
        put(found.filter("not ignored").select(*columns), "findings")
        put(keyed.select("path", "content_hash").distinct().withColumn("at", now), "seen")

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def latest_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of each path's last delivery, by the clock of the drivers that
    stored them. A batch counts once its keys are stored; a repeated one
    replaces itself. Of several texts of one path in one batch the one of the
    greatest content hash counts. Only keys and findings move, no texts."""
    seen = stored_table(spark, f"{out}/seen", _SEEN)
    last = seen.groupBy("path").agg(
        F.max(F.struct("at", "content_hash", "delivery")).alias("last")
    ).select("path", "last.content_hash", "last.delivery")
    found = stored_table(spark, f"{out}/findings", _FOUND)
    same = [found[c].eqNullSafe(last[c]) for c in _VERSION]
    return found.join(last, same, "left_semi").drop("content_hash", "delivery")
