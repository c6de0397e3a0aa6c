"""Ignore files as a table of patterns, which paths meet by their folders."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.sources.small import small_table
from tamis.sources.storage import read_bytes

# Patterns, and ignored paths, are broadcast up to this size, which is measured.
BROADCAST_BYTES = 128 << 20
# Which kind of file decides when several match.
GLOBAL, EXCLUDE, IN_TREE = 0, 1, 2
_SOURCE = "path:string,dir:string,rank:int"
_PART = re.compile(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]+\]|\\.|[^*?\[\\]+|.", re.S)
# What each operator of the pattern language may span.
_SPANS = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def ignore_regex(line: str) -> tuple[bool, str] | None:
    """(un-ignores, regex over the path below the file's directory)"""
    text = re.sub(r"(?<!\\)\s+$", "", line)
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    body = text[1:] if keep else text
    only_folders, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.removeprefix("/")

    def part(p: str) -> str:
        if p in _SPANS:
            return _SPANS[p]
        if p.startswith("[") and p.endswith("]") and len(p) > 2:
            return "[" + p[1:-1].replace("!", "^", p.startswith("[!")) + "]"
        return re.escape(p[1:] if p.startswith("\\") and len(p) == 2 else p)

    regex = "".join(map(part, _PART.findall(body)))
    # A pattern that hits a folder hits all below it.
    return keep, f"^{'' if anchored else '(?:.*/)?'}{regex}{'/' if only_folders else '(?:/|$)'}"


def outer_ignore_files(root: str) -> list[dict]:
    """For a mounted ``root`` inside a git repository: ignore files of the
    folders above it, the repository's own list, and the user's global one."""
    here = Path(root).resolve()
    repo = next((p for p in (here, *here.parents) if (p / ".git").exists()), None)
    if repo is None:
        return []
    above = [p for p in here.parents if p.is_relative_to(repo)]
    named = subprocess.run(
        ["git", "-C", str(repo), "config", "--path", "core.excludesFile"],
        capture_output=True, text=True, check=False,
    ).stdout.strip()
    config = os.environ.get("XDG_CONFIG_HOME") or str(Path.home() / ".config")
    out = [{"path": f"{p}/.gitignore", "dir": f"{p}/", "rank": IN_TREE} for p in above]
    if repo != here:
        out.append({"path": f"{repo}/.git/info/exclude", "dir": f"{repo}/", "rank": EXCLUDE})
    out.append({"path": named or f"{config}/git/ignore", "dir": f"{repo}/", "rank": GLOBAL})
    return [o for o in out if os.path.isfile(o["path"])]


def ignore_patterns(spark: SparkSession, hidden: DataFrame, outer: list[dict]) -> DataFrame:
    """(dir, rank, line, keep, regex) of the ignore files among the ``hidden``
    files of a tree and of those that lie outside it; tasks read them."""
    path = F.col("path")
    inside = hidden.select(
        "path",
        F.when(F.endswith(path, F.lit("/.gitignore")), F.regexp_replace(path, r"\.gitignore$", ""))
        .when(
            F.endswith(path, F.lit("/.git/info/exclude")),
            F.regexp_replace(path, r"\.git/info/exclude$", ""),
        )
        .alias("dir"),
        F.when(F.endswith(path, F.lit("/.gitignore")), IN_TREE).otherwise(EXCLUDE).alias("rank"),
    ).filter("dir is not null")
    if outer:
        inside = inside.unionByName(small_table(spark, outer, _SOURCE))

    def parsed(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, folder, rank in zip(frame["path"], frame["dir"], frame["rank"]):
                lines = (read_bytes(name) or b"").decode(errors="replace").splitlines()
                for number, line in enumerate(lines):
                    if found := ignore_regex(line):
                        rows.append((folder, rank, number, *found))
            yield pd.DataFrame(rows, columns=["dir", "rank", "line", "keep", "regex"])

    return inside.mapInPandas(parsed, "dir string, rank int, line int, keep boolean, regex string")


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def git_ignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those ``paths`` whose last matching pattern ignores them. A path meets
    the patterns of the folders that it lies in; files of the tree win over the
    repository's list and this over the global one, then deeper folders and
    later lines."""
    parts = F.split("path", "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    inside = paths.filter(F.contains("path", F.lit("/"))).select("path", F.explode(folders).alias("dir"))
    if _small(patterns, F.octet_length("dir") + F.octet_length("regex") + 64):
        patterns = F.broadcast(patterns)
    rest = F.substring("path", F.length("dir") + 1, F.length("path"))
    hits = inside.join(patterns, "dir").filter(F.regexp_instr(rest, F.col("regex")) > 0)
    last = F.max_by("keep", F.struct("rank", F.length("dir"), "line"))
    return hits.groupBy("path").agg(last.alias("keep")).filter("not keep").select("path")
