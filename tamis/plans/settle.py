"""Cutting a plan in two where its result is read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster, which all executors reach. A local
    session, which is one machine, may do without the setting: it gets one
    temporary folder. Anything else has to name a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tamis-")
    return _LOCAL[context.applicationId]


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: they are computed
    once and survive the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
