"""The file relation: (path, text, lang, n_bytes), from directories or tables."""

from __future__ import annotations

import re
import warnings
from collections import deque
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.globs import path_allowed
from tamis.functions.language import language_or_generic
from tamis.plans.settle import settled
from tamis.sources.gitignore import BROADCAST_BYTES, git_ignored, ignore_patterns, outer_ignore_files
from tamis.sources.small import small_table
from tamis.sources.storage import file_system, list_folder, read_bytes

# Entries that a task lists below one folder before it hands back the rest.
LISTED_AT_ONCE = 10_000


def from_table(df: DataFrame, path: Column, text: Column, *keep: str) -> DataFrame:
    """Any table with a text column as a file relation."""
    return df.select(*keep, path.alias("path"), text.alias("text")).withColumns(
        {
            "lang": language_or_generic(F.col("path")),
            "n_bytes": F.octet_length("text").cast("bigint"),
        }
    )


def spread(table: DataFrame) -> DataFrame:
    """Few large input splits are spread over all cores. Where the input has
    more splits than cores, as big tables have, nothing is shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def allowed(files: DataFrame, root: str, include: tuple = (), exclude: tuple = ()) -> DataFrame:
    return files.filter(path_allowed(F.col("path"), root, tuple(include), tuple(exclude)))


def _is_hidden(name: str) -> bool:
    """Whether Spark's file listing leaves the name out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")


def _lister(limit: int):
    def listed(frames):
        """Hidden files below folders, by breadth; past ``limit`` entries of one
        folder what is still to be listed is handed back."""
        import pandas as pd

        for frame in frames:
            for top, in_hidden in zip(frame["path"], frame["hidden"]):
                todo, seen, found = deque([(top, bool(in_hidden))]), 0, []
                while todo and seen < limit:
                    here, inside = todo.popleft()
                    for path, folder in list_folder(here):
                        seen += 1
                        hidden = inside or _is_hidden(path.rpartition("/")[2])
                        if folder:
                            todo.append((path, hidden))
                        elif hidden:
                            found.append((path, False, True))
                found += [(path, True, hidden) for path, hidden in todo]
                yield pd.DataFrame(found, columns=["path", "folder", "hidden"])

    return listed


def _hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below ``root`` that Spark's file listing takes for
    hidden. Tasks list the folders; a round deals out what the last one left."""
    found = []
    todo = small_table(spark, [{"path": root, "hidden": False}], "path:string,hidden:boolean")
    while True:
        listed = settled(
            todo.mapInPandas(_lister(LISTED_AT_ONCE), "path string, folder boolean, hidden boolean")
        )
        found.append(listed.filter("not folder").select("path"))
        todo = listed.filter("folder").select("path", "hidden")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        todo = todo.repartition(spark.sparkContext.defaultParallelism)


def _content(path: Column) -> Column:
    """The bytes of the files, null where one cannot be read."""

    def read(paths):
        import pandas as pd

        return pd.Series([read_bytes(p) for p in paths])

    return F.pandas_udf(read, T.BinaryType())(path)


def _read(paths: DataFrame) -> DataFrame:
    content = spread(paths).select("path", _content(F.col("path")).alias("content"))
    return content.select(
        "path", "content", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("length")
    )


def _without_ignored(raw: DataFrame, patterns: DataFrame) -> DataFrame:
    """Only names are judged. Contents stay where they are read while the
    ignored names can be broadcast; beyond that tasks read the names that are left."""
    names = raw.select("path")
    ignored = settled(git_ignored(names, patterns))
    if (ignored.agg(F.sum(F.octet_length("path") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        return raw.join(F.broadcast(ignored), "path", "left_anti")
    return _read(names.join(ignored, "path", "left_anti"))


def _listable(root: str) -> bool:
    try:
        file_system(root)
    except Exception as e:  # what pyarrow raises depends on the scheme
        warnings.warn(f"hidden files below {root} are left out: {e}", stacklevel=3)
        return False
    return True


def from_path(spark: SparkSession, root: str, names: tuple[str, ...] = ()) -> DataFrame:
    """All files below ``root``, hidden ones too, without those that
    ignore files exclude. Column ``text`` is null where the content is
    not UTF-8 (such files still count as seen).

    With ``names`` only files so called are listed, before any content is read.

    Inside a git repository the ignore files above a mounted ``root``, the
    repository's own list and the user's global one count as well.

    Spark lists and reads the tree in parallel. It leaves hidden files out;
    tasks list these and read them, on any storage that pyarrow knows. On
    others they are left out with a warning."""
    root = re.sub("^file:/+", "/", root)
    local = Path(root)
    mounted = "://" not in root
    if mounted and not local.exists():
        raise FileNotFoundError(f"path does not exist: {root}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if names and (not mounted or local.is_dir()):
        reader = reader.option("pathGlobFilter", "{" + ",".join(names) + "}")
    raw = reader.load(root).select("path", "content", "length")
    raw = raw.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    base = str(local.resolve()) if mounted else root.rstrip("/")
    if local.is_dir() if mounted else _listable(root):
        hidden = _hidden_files(spark, base)
        wanted = hidden
        if names:
            wanted = hidden.filter(F.substring_index("path", "/", -1).isin(*names))
        if not wanted.isEmpty():
            raw = raw.unionByName(_read(wanted))
        patterns = settled(ignore_patterns(spark, hidden, outer_ignore_files(base) if mounted else []))
        if not patterns.isEmpty():
            raw = _without_ignored(raw, patterns)
    files = raw.select(
        "path",
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
        F.col("length").alias("n_bytes"),
    )
    if mounted and root != base:
        # Report paths the way the root was given.
        rest = F.substring(F.col("path"), len(base) + 1, 2**31 - 1)
        given = F.concat(F.lit(root.rstrip("/")), rest)
        files = files.withColumn(
            "path", F.when(F.startswith("path", F.lit(base)), given).otherwise(F.col("path"))
        )
    return files.withColumn("lang", language_or_generic(F.col("path")))
