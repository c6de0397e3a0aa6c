"""What the operators share: intermediate tables, batches, checks of sizes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.plans.settle import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back. Later jobs start from the files, so
    a lost executor costs none of the work before."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict = {}
_ASKED: set = set()


def kept_in_worker(key, make: Callable):
    """What ``make`` gives, which a Python worker keeps for its next tasks as long as
    they ask for it too."""
    _ASKED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def begun(make: Callable):
    """What ``make`` gives at the start of a task. Of all that earlier tasks kept, what
    it did not ask for goes, and its memory back to the system."""
    _ASKED.clear()
    made = make()
    gone = _KEPT.keys() - _ASKED
    for key in gone:
        del _KEPT[key]
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if gone else None
    if trim:
        trim(0)
    return made


def per_batch(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]
) -> DataFrame:
    """One Arrow batch in, one out. ``make`` runs once per task and returns the
    function for its batches. What a worker keeps for other tasks goes then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = begun(make)
        for batch in batches:
            out = convert(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a text column each, so
    that long texts do not add up in memory."""
    offset, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= limit:
            yield batch.slice(offset, i + 1 - offset)
            offset, size = i + 1, 0
    if offset < batch.num_rows:
        yield batch.slice(offset)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
