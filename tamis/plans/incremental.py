"""Re-scanning only what changed.

Two tables in the cache's live version (``cache_store``), partitioned by the
hash of the rules: ``scanned`` lists the (path, content hash) pairs done,
``findings`` what was found in them. Both carry the id of the run that wrote them, and a finding
only counts if its run reached ``scanned``, so a run that dies half way leaves
nothing behind that is believed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.matching import compile_rules
from tamis.plans.cache_store import (
    FILE_BYTES,
    FINDINGS,
    SCANNED,
    Retention,
    cache_files,
    compact,
    live_version,
    new_run,
    retire,
    stored_table,
)
from tamis.plans.scan import raw_findings
from tamis.plans.settle import settled

# Keys of changed files are broadcast up to this size, which is measured. More
# of them are joined by a shuffle.
BROADCAST_BYTES = 128 << 20
# Runs append files; with more than these, besides the ones that full files would
# be, the cache is rewritten.
MAX_FILES = 400


def content_hash() -> Column:
    return F.xxhash64("text")


def rules_hash(rules, ignore_tokens: tuple[str, ...] = ()) -> str:
    """Over all fields of all rules, so that any edit invalidates."""
    compiled = compile_rules(rules)
    return hashlib.sha256(repr((compiled.rules, ignore_tokens)).encode()).hexdigest()[:16]


def split_by_cache(keys: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (path, content_hash) keys. What several runs scanned
    side by side counts once, as the newest of them found it."""
    on = ["path", "content_hash"]
    done = scanned.groupBy(*on).agg(F.max("run").alias("run"))
    return keys.join(done, on), keys.join(done.select(*on), on, "left_anti")


@dataclass
class CachedScan:
    findings: DataFrame
    cache_hits: int
    rescanned: int


def incremental_findings(
    files: DataFrame, rules, cache_dir: str, ignore_tokens: tuple[str, ...]
) -> CachedScan:
    """Findings of ``files``, reading those of unchanged files from the cache
    and adding the others to it."""
    spark = files.sparkSession
    compiled = compile_rules(rules)
    version = rules_hash(compiled, ignore_tokens)
    run, live = new_run(), live_version(spark, cache_dir)
    files = files.withColumn("content_hash", content_hash())
    of_rules = F.col("rules_hash") == version
    scanned = stored_table(spark, f"{live}/scanned", SCANNED).filter(of_rules)
    stored = stored_table(spark, f"{live}/findings", FINDINGS).filter(of_rules)
    # The texts are read once to hash them, and once more where they changed.
    keys = settled(files.select("path", "content_hash"))
    hits, misses = split_by_cache(keys, scanned)
    n_hits = hits.count()
    n_misses, n_bytes = misses.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("path") + 64), F.lit(0))
    ).first()
    todo = files
    if n_hits:
        # Where the keys are small only they move; the texts stay where they are read.
        wanted = F.broadcast(misses) if n_bytes <= BROADCAST_BYTES else misses
        todo = files.join(wanted, ["path", "content_hash"], "left_semi")
    if n_misses:
        fresh = raw_findings(todo, compiled, ignore_tokens, carry=("content_hash",))
        stamp = {"run": F.lit(run), "rules_hash": F.lit(version)}
        fresh.withColumns(stamp).write.mode("append").partitionBy("rules_hash").parquet(
            f"{live}/findings"
        )
        new_keys = misses if n_hits else keys
        new_keys.withColumns(stamp).write.mode("append").partitionBy("rules_hash").parquet(
            f"{live}/scanned"
        )
        scanned = stored_table(spark, f"{live}/scanned", SCANNED).filter(of_rules)
        stored = stored_table(spark, f"{live}/findings", FINDINGS).filter(of_rules)
        if not n_hits:
            scanned = scanned.filter(F.col("run") == run)
    current, _ = split_by_cache(keys, scanned)
    found = stored.join(current, ["path", "content_hash", "run"], "left_semi")
    return CachedScan(found.drop("content_hash", "run", "rules_hash"), n_hits, n_misses)


def tidy_cache(
    spark: SparkSession, cache_dir: str, max_files: int = MAX_FILES, keep: Retention | None = None
) -> bool:
    """After a scan: rewrites a cache of too many files, without what ``keep``
    drops, and deletes versions that nobody reads any more. Whether it was
    rewritten."""
    files, size = cache_files(spark, cache_dir)
    many = files > max_files + 2 * (size // FILE_BYTES)
    if many:
        compact(spark, cache_dir, keep or Retention())
    retire(spark, cache_dir)
    return many
