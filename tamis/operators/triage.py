"""Offline scoring of findings and checking of proposed fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import let, lines
from tamis.operators.findings import FINDING_COLUMNS, apply_snippet
from tamis.plans.settle import settled

# Fixes are broadcast up to this size, which is measured.
BROADCAST_BYTES = 128 << 20

# Words that make a finding likely to be real.
TELLING_WORDS = (
    "execute", "eval", "system", "innerHTML", "exec(", "raw(", "unserialize",
    "pickle", "readObject", "Deserialize", "AKIA", "PRIVATE KEY",
)
LIKELY, UNLIKELY, THRESHOLD = 0.9, 0.4, 0.5


def triage(findings: DataFrame) -> DataFrame:
    """Adds is_tp, confidence, reason, fixed_snippet."""
    as_text = F.to_json(F.struct(*[c for c in FINDING_COLUMNS if c in findings.columns]))
    telling = reduce(
        lambda a, b: a | b, [F.contains(as_text, F.lit(w)) for w in TELLING_WORDS]
    )
    confidence = F.when(telling, LIKELY).otherwise(UNLIKELY)
    return findings.withColumns(
        {
            "is_tp": confidence >= THRESHOLD,
            "confidence": confidence,
            "reason": F.lit("offline heuristic"),
            "fixed_snippet": F.lit(""),
        }
    )


def outermost_object(text: Column) -> Column:
    """The part from the first brace to the last, for JSON amid other words."""
    whole = F.try_parse_json(text)
    return F.when(whole.isNotNull(), text).otherwise(
        F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    )


def patched_files(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files with one line replaced per (path, line, fixed_snippet). Each fix
    makes its own version of the file, told apart by ``patched_line``.

    The fixes are settled and measured: up to ``BROADCAST_BYTES`` they go to the
    files, which then stay where they are read. More of them, with the texts of
    their files, meet in a shuffle."""
    text, line = F.col("text"), F.col("patched_line")
    fixes = settled(
        fixes.filter("fixed_snippet <> ''")
        .select("path", F.col("line").alias("patched_line"), "fixed_snippet")
        .distinct()
    )
    size = F.sum(F.octet_length("path") + F.octet_length("fixed_snippet") + 64)
    if (fixes.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        fixes = F.broadcast(fixes)

    def patched(rows: Column) -> Column:
        before = F.concat(F.slice(rows, 1, line - 1), F.array(F.lit("")))
        fixed = apply_snippet(F.element_at(rows, line), F.col("fixed_snippet"))
        after = F.array_join(F.slice(rows, line + 1, F.size(rows)), "\n")
        return F.when(
            line.between(1, F.size(rows)), F.concat(F.array_join(before, "\n"), fixed, after)
        )

    versions = files.join(fixes, "path").withColumn("text", let(lines(text), patched))
    return versions.drop("fixed_snippet").filter("text is not null")


def verified(findings: DataFrame, after: DataFrame) -> DataFrame:
    """Findings whose line is clean in the version that patched it. ``after``
    are the findings of the patched files, with ``patched_line``."""
    still = after.filter(F.col("line") == F.col("patched_line")).select("rule_id", "path", "line")
    return findings.join(still, ["rule_id", "path", "line"], "left_anti")
