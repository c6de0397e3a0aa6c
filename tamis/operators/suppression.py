"""Dropping findings: suppression entries and changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.globs import glob_regex, is_glob, relative_path
from tamis.plans.settle import settled
from tamis.sources.small import small_table
from tamis.sources.suppressions import Suppression

# Ends of paths are broadcast up to this size, which is measured.
BROADCAST_BYTES = 128 << 20
_ENTRIES = "rule_id:string,entries:array<struct<path:string,glob:boolean,line:int>>"


def _rule_test(entries: list[Suppression], rule_id: Column) -> list[tuple[Column, Suppression]]:
    return [
        (F.rlike(rule_id, F.lit(glob_regex(e.rule))), e) for e in entries if is_glob(e.rule)
    ]


def _path_test(path: Column, rel: Column, pattern: Column, glob: Column) -> Column:
    def hit(c: Column) -> Column:
        return F.when(glob, F.regexp_instr(c, pattern) > 0).otherwise(F.contains(c, pattern))

    return pattern.isNull() | hit(path) | F.coalesce(hit(rel), F.lit(False))


def _path_field(e: Suppression) -> tuple[str | None, bool]:
    if e.path is None:
        return None, False
    glob = is_glob(e.path)
    return (glob_regex(e.path, any_suffix=True) if glob else e.path), glob


def flag_suppressed(
    findings: DataFrame, entries: list[Suppression], root: str = ""
) -> DataFrame:
    """Adds ``suppressed``: some entry names the rule (exactly or by glob) and,
    if it gives them, the path and the line.

    Entries for exact rules are grouped per rule on the driver, so the join is
    one-to-one on rule_id and cannot multiply findings."""
    if not entries:
        return findings.withColumn("suppressed", F.lit(False))
    path, line = F.col("path"), F.col("line")
    rel = relative_path(path, root)
    grouped: dict[str, list[dict]] = {}
    for e in entries:
        if not is_glob(e.rule):
            pattern, glob = _path_field(e)
            grouped.setdefault(e.rule, []).append({"path": pattern, "glob": glob, "line": e.line})
    flag = F.lit(False)
    for named, e in _rule_test(entries, F.col("rule_id")):
        pattern, glob = _path_field(e)
        flag = flag | (
            named
            & _path_test(path, rel, F.lit(pattern).cast("string"), F.lit(glob))
            & (F.lit(e.line is None) | (line == F.lit(e.line)))
        )
    if not grouped:
        return findings.withColumn("suppressed", F.coalesce(flag, F.lit(False)))
    rows = [{"rule_id": r, "entries": e} for r, e in grouped.items()]
    table = small_table(findings.sparkSession, rows, _ENTRIES)
    if sum(len(v) for v in grouped.values()) <= 100_000:
        table = F.broadcast(table)
    exact = F.exists(
        "entries",
        lambda e: _path_test(path, rel, e["path"], e["glob"])
        & (e["line"].isNull() | (e["line"] == line)),
    )
    return (
        findings.join(table, "rule_id", "left")
        .withColumn(
            "suppressed", F.coalesce(exact, F.lit(False)) | F.coalesce(flag, F.lit(False))
        )
        .drop("entries")
    )


def _endings(rows: DataFrame, lengths: Column) -> DataFrame:
    """``rows`` with each ``end`` of their path that is as long as one of
    ``lengths``, and whether it is the ``whole`` path."""
    size = F.length("path")
    fits = F.filter(lengths, lambda n: n.between(1, size - 1))
    return rows.select(
        "*", F.explode(F.concat(F.array(size), fits)).alias("_n")
    ).select(*rows.columns, F.expr("right(path, _n)").alias("end"), (F.col("_n") == size).alias("whole"))


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines. A file is the same when one path ends with
    the other.

    The findings are settled, so texts and changes are read once each. Ends of
    paths meet on (end, line), and one of the two has to be a whole path, so
    the join makes true pairs only. The ends of the findings' paths are
    broadcast up to ``BROADCAST_BYTES``, which is measured; the changes then
    stay where they are."""
    found = settled(findings)
    places = found.select("path", "line").distinct()
    size = F.length("path")
    lengths, ends_bytes = places.agg(
        F.collect_set(size), F.sum((size * (size + 1) / 2) * 4 + size * 64)
    ).first()
    ours = _endings(places, F.sequence(F.lit(1), F.greatest(size, F.lit(1))))
    if (ends_bytes or 0) <= BROADCAST_BYTES:
        ours = F.broadcast(ours)
    theirs = _endings(changed.select("path", "line"), F.lit(lengths).cast("array<int>"))
    ours, theirs = ours.alias("ours"), theirs.alias("theirs")
    same = (
        (F.col("ours.end") == F.col("theirs.end"))
        & (F.col("ours.line") == F.col("theirs.line"))
        & (F.col("ours.whole") | F.col("theirs.whole"))
    )
    hit = theirs.join(ours, same).select("ours.path", "ours.line").distinct()
    return found.join(hit, ["path", "line"], "left_semi")
