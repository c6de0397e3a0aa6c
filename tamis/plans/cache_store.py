"""Where the tables of the incremental scan lie, and their upkeep.

Every run appends files. :func:`compact` writes what is still wanted into a new
folder and makes it the live version by creating one small file, which happens
or does not. Runs look up the live version once, at their start: one that began
before a switch goes on reading, and writing, the version it knows. What it adds
there after the switch is not carried over; those files are scanned again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCANNED = "path string, content_hash bigint, run string, rules_hash string"
FINDINGS = (
    "rule_id string, path string, line int, snippet string, language string, col int, "
    "rule_ord int, pat_ord int, match_ord int, ignored boolean, severity string, "
    "message string, fix string, content_hash bigint, run string, rules_hash string"
)
FILE_BYTES = 128 << 20


def new_run() -> str:
    """Ids in the order of time, behind all ids that do not begin with a t."""
    return f"t{time.time_ns():020d}-{uuid.uuid4().hex}"


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty before the first run. A damaged one is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class _Folder:
    """A folder of any storage that Spark reaches, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *names: str):
        path = self.root
        for name in names:
            path = self._path(path, name)
        return path

    def entries(self, *names: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds)."""
        path = self.at(*names)
        if not self.fs.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(path)]

    def size(self, *names: str) -> tuple[int, int]:
        """(files, bytes) below."""
        path = self.at(*names)
        if not self.fs.exists(path):
            return 0, 0
        found = self.fs.getContentSummary(path)
        return found.getFileCount(), found.getLength()


def live_version(spark: SparkSession, cache_dir: str) -> str:
    """The folder of the tables; the cache directory itself before the first
    compaction."""
    names = [name for name, _ in _Folder(spark, cache_dir).entries("versions")]
    return f"{cache_dir.rstrip('/')}/data-{max(names)}" if names else cache_dir.rstrip("/")


def cache_files(spark: SparkSession, cache_dir: str) -> tuple[int, int]:
    """(data files, bytes) of the live version."""
    folder = _Folder(spark, live_version(spark, cache_dir))
    sizes = [folder.size(table) for table in ("scanned", "findings")]
    return sum(n for n, _ in sizes), sum(b for _, b in sizes)


@dataclass(frozen=True)
class Retention:
    """What a compaction keeps: per path and set of rules the newest ``contents``
    that were scanned, the ``rule_sets`` used last (None: all), and of the paths
    those in ``paths`` (a table with the column path; None: all)."""

    contents: int = 2
    rule_sets: int | None = None
    paths: DataFrame | None = None


def kept_keys(scanned: DataFrame, keep: Retention) -> DataFrame:
    """One row, of the newest run, for each key that stays. A key that several
    runs scanned is one key; a null path is a path like any other."""
    key = ["rules_hash", "path", "content_hash"]
    once = scanned.groupBy(*key).agg(F.max("run").alias("run"))
    newest = Window.partitionBy("rules_hash", "path").orderBy(F.desc("run"), F.asc("content_hash"))
    kept = once.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep.contents).drop("_n")
    if keep.rule_sets is not None:
        # one row a set of rules: as many as there were versions of the rules
        last = scanned.groupBy("rules_hash").agg(F.max("run").alias("_last"))
        sets = last.orderBy(F.desc("_last"), "rules_hash").limit(keep.rule_sets).select("rules_hash")
        kept = kept.join(sets, "rules_hash", "left_semi")
    if keep.paths is not None:
        wanted = keep.paths.select(F.col("path").alias("_path")).distinct()
        kept = kept.join(wanted, F.col("path").eqNullSafe(F.col("_path")), "left_semi")
    return kept


def compact(spark: SparkSession, cache_dir: str, keep: Retention = Retention()) -> str:
    """Rewrites the live version with few files and without what is not kept;
    returns the folder that is live now. If it fails half way, the old version
    stays live and the rest is left to :func:`retire`."""
    source, folder = live_version(spark, cache_dir), _Folder(spark, cache_dir)
    number = max([int(name.split("-")[0]) for name, _ in folder.entries("versions")], default=0) + 1
    name = f"{number:010d}-{uuid.uuid4().hex}"
    target = f"{cache_dir.rstrip('/')}/data-{name}"
    here = _Folder(spark, source)

    def write(rows: DataFrame, table: str, *order: str) -> None:
        parts = -(-here.size(table)[1] // FILE_BYTES) or 1
        # ranges, so that one set of rules may fill many files and each file holds few sets
        spread = rows.repartitionByRange(parts, "rules_hash", "path", *order)
        spread.write.partitionBy("rules_hash").parquet(f"{target}/{table}")

    write(kept_keys(stored_table(spark, f"{source}/scanned", SCANNED), keep), "scanned", "content_hash")
    # what has just been written decides, not a second look at a table that may have grown
    keys = stored_table(spark, f"{target}/scanned", SCANNED).select(
        *(F.col(c).alias(f"_{c}") for c in ("rules_hash", "path", "content_hash", "run"))
    )
    found = stored_table(spark, f"{source}/findings", FINDINGS)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("path", "content_hash")]
    same += [F.col(c) == F.col(f"_{c}") for c in ("rules_hash", "run")]
    write(found.join(keys, same, "left_semi"), "findings", "line", "rule_ord")
    folder.fs.create(folder.at("versions", name), False).close()
    return target


def retire(spark: SparkSession, cache_dir: str, grace_seconds: float = 86_400) -> list[str]:
    """Deletes folders of versions that are not live and were last changed, as was
    the live one, more than ``grace_seconds`` ago, so that whoever still reads
    them has had that long to finish; returns their names. Leftovers of
    compactions that failed go the same way."""
    folder = _Folder(spark, cache_dir)
    switched = dict(folder.entries("versions"))
    if not switched:
        return []
    live, before = max(switched), (time.time() - grace_seconds) * 1000
    if switched[live] > before:
        return []
    gone = []
    for name, changed in folder.entries():
        old = name in ("scanned", "findings") or (name.startswith("data-") and name != f"data-{live}")
        # a version that was being written when the live one was made may be newer than it
        if old and changed <= before:
            folder.fs.delete(folder.at(name), True)
            gone.append(name)
    for name in switched:
        if name != live and f"data-{name}" in gone:
            folder.fs.delete(folder.at("versions", name), False)
    return sorted(gone)
