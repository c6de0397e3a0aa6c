"""Changed lines from unified diffs: a table of texts, or files of any size."""

from __future__ import annotations

import shutil
import subprocess
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.plans.settle import settled, shared_folder
from tamis.sources.storage import file_system

_HEADER = "+++ b/"
_HUNK = r"^@@ [^+]*\+(\d+)(?:,(\d+))? @@"


def _hunk(start: Column, count: Column) -> Column:
    """A hunk without a count has one line."""
    return F.struct(
        start.cast("int").alias("start"),
        F.when(count == "", 1).otherwise(count.cast("int")).alias("count"),
    )


def _lines(hunks: DataFrame) -> DataFrame:
    """(path, line) of hunks (path, h). A hunk of zero lines only deletes."""
    return (
        hunks.filter("h.count > 0")
        .select(
            "path",
            F.explode(F.sequence("h.start", F.col("h.start") + F.col("h.count") - 1)).alias("line"),
        )
        .distinct()
    )


def changed_lines(diffs: DataFrame, text: str = "text") -> DataFrame:
    """(path, line) added or changed by the diffs in column ``text``.

    Each diff is cut at its file headers, so a hunk finds its file in its own
    section and no ordering over lines is needed."""
    cut = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\+\+\+ b/", -1)
    in_file = diffs.select(F.posexplode(cut).alias("n", "section"))
    hunks = in_file.filter("n > 0").select(
        F.regexp_replace(F.substring_index("section", "\n", 1), "\r$", "").alias("path"),
        F.explode(
            F.zip_with(
                F.regexp_extract_all("section", F.lit("(?m)" + _HUNK), F.lit(1)),
                F.regexp_extract_all("section", F.lit("(?m)" + _HUNK), F.lit(2)),
                _hunk,
            )
        ).alias("h"),
    )
    return _lines(hunks)


def _named():
    """Marks in the order of their splits to hunks with the header before them,
    and a row ``ends`` with the last header of each split. (A local function: it
    travels with the plan.)"""

    def named(frames):
        import pandas as pd

        out = ["file", "split", "name", "start", "count", "ends"]
        now, last = None, None
        for frame in frames:
            parts = []
            for key, rows in frame.groupby(["file", "split"], sort=False):
                if key != now:
                    if now is not None:
                        parts.append(pd.DataFrame([[*now, last, None, None, True]], columns=out))
                    now, last = key, None
                names = [last := name if name is not None else last for name in rows["name"]]
                hunks = rows.assign(name=names, ends=False)
                parts.append(hunks[hunks["start"].notna()][out])
            yield from parts
        if now is not None:
            yield pd.DataFrame([[*now, last, None, None, True]], columns=out)

    return named


def changed_lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of diff files below ``path``, each read by as many tasks as it
    has splits.

    Only header and hunk lines are kept. The task that reads a split goes
    through them in order, so a hunk takes the header before it and nothing is
    sorted; hunks in front of a split's first header take the last one of the
    splits before, which one row a split tells."""
    value = F.col("value")
    name = F.when(
        F.startswith(value, F.lit(_HEADER)),
        F.regexp_replace(F.substring(value, len(_HEADER) + 1, 2**31 - 1), "\r$", ""),
    )
    part = lambda i: F.regexp_extract(value, _HUNK, i)
    marks = (
        spark.read.option("lineSep", "\n").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            name.alias("name"),
            F.when(F.startswith(value, F.lit("@@ ")) & (part(1) != ""), _hunk(part(1), part(2))).alias("h"),
        )
        .filter("name is not null or h is not null")
        .select("file", "split", "name", "h.*")
    )
    rows = settled(
        marks.mapInPandas(
            _named(), "file string, split long, name string, start int, count int, ends boolean"
        )
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.filter("ends").select(
        "file", "split", F.last("name", ignorenulls=True).over(earlier).alias("path")
    )
    h = F.struct("start", "count").alias("h")
    hunks = rows.filter("not ends")
    headless = hunks.filter("name is null").join(carried.filter("path is not null"), ["file", "split"])
    return _lines(
        hunks.filter("name is not null").select(F.col("name").alias("path"), h)
        .unionByName(headless.select("path", h))
    )


def git_diff(spark: SparkSession, repo: str, baseline: str) -> DataFrame:
    """Changed lines of a local checkout against ``baseline``; a failing git is
    an error, not an empty diff. The diff goes to the shared folder as git
    writes it, so no process holds it whole."""
    git = ["git", "-C", repo]
    known = subprocess.run(
        [*git, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{baseline}^{{commit}}"],
        capture_output=True,
        check=False,
    )
    if known.returncode:
        why = known.stderr.decode(errors="replace").strip() or f"unknown revision {baseline}"
        raise RuntimeError(f"git diff failed: {why}")
    spool = f"{shared_folder(spark)}/diff-{uuid.uuid4().hex}"
    system, inner = file_system(spool)
    command = [*git, "diff", "-U0", "--end-of-options", f"{baseline}...HEAD", "--"]
    with (
        subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run,
        system.open_output_stream(inner, compression=None) as out,
    ):
        shutil.copyfileobj(run.stdout, out, 1 << 20)
    if run.returncode:
        raise RuntimeError(f"git diff failed with code {run.returncode}")
    return changed_lines_of_files(spark, spool)
