"""From raw hits to findings: de-duplication, order, severity floor, ignores."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.severity import parse_floor, severity_rank
from tamis.functions.text import lines, trim_start_ws, trim_ws

FINDING_COLUMNS = (
    "rule_id", "severity", "message", "fix", "path", "language", "line", "col", "snippet",
)
# Position of a finding among those of its line; makes every order total.
ORDER_COLUMNS = ("rule_ord", "pat_ord", "match_ord")
IGNORE_TOKEN = "tamis-ignore"
# What opens a comment.
COMMENT_MARKERS = ("#", "//", "<!--", "/*")


# -- inline ignores ----------------------------------------------------------


@lru_cache(maxsize=16)
def ignore_comments(tokens: tuple[str, ...] = (IGNORE_TOKEN,)) -> Column:
    """array<struct<line, ids>>: the lines of column ``text`` on which ignore
    comments take effect; null ids stand for all rules. Null when the text has
    no token."""
    text = F.col("text")
    names = "|".join(_quote(t) for t in tokens)
    # Token at a word boundary, optionally for the next line, optionally with
    # a list of ids. An open parenthesis without an end voids the comment.
    comment = (
        rf"(?<![\p{{IsAlphabetic}}\p{{N}}_-])(?:{names})"
        r"((?:-next-line)?+\s*+(?:\([^)]*\)|(?!\()))"
    )
    markers = "|".join(_quote(m) for m in COMMENT_MARKERS)

    def on_line(line: Column, i: Column) -> Column:
        in_comment = F.regexp_extract(line, f"(?s)((?:{markers}).*)$", 1)
        return F.transform(
            F.regexp_extract_all(in_comment, F.lit(comment), F.lit(1)),
            lambda c: F.struct(
                (i + 1 + F.startswith(c, F.lit("-next-line")).cast("int")).alias("line"),
                F.when(
                    F.contains(c, F.lit("(")),
                    F.filter(
                        F.transform(
                            F.split(F.regexp_extract(c, r"(?s)\((.*)\)", 1), ",", -1), trim_ws
                        ),
                        lambda s: s != "",
                    ),
                ).alias("ids"),
            ),
        )

    present = F.lit(False)
    for t in tokens:
        present = present | F.contains(text, F.lit(t))
    return F.when(present, F.flatten(F.transform(lines(text), on_line)))


def _quote(literal: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "_ ") else c for c in literal)


def is_ignored(ignores: Column, rule_id: Column, line: Column) -> Column:
    return F.coalesce(
        F.exists(
            ignores,
            lambda g: (g["line"] == line)
            & (g["ids"].isNull() | F.array_contains(g["ids"], rule_id)),
        ),
        F.lit(False),
    )


# -- findings ----------------------------------------------------------------


def deduplicate(hits: DataFrame) -> DataFrame:
    """One row per (rule, path, line, snippet): the first in encounter order.

    A hash aggregate with map-side combining rather than a window: no group is
    ever brought together as rows, whatever the skew. Encounter order is one
    number, for pattern ordinals follow rule ordinals, and gives both ordinals
    back; all other columns depend on the key."""
    numbers = ("rule_ord", "pat_ord", "match_ord", "col")
    key = [c for c in hits.columns if c not in numbers]
    order = F.shiftleft(F.col("pat_ord").cast("bigint"), 32) + F.col("match_ord")
    firsts = hits.groupBy(*key).agg(
        F.min("rule_ord").alias("rule_ord"), F.min(order).alias("_order"), F.min_by("col", order).alias("col")
    )
    return firsts.select(
        *key,
        "rule_ord",
        F.shiftright("_order", 32).cast("int").alias("pat_ord"),
        F.col("_order").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("match_ord"),
        "col",
    )


def with_rule_fields(hits: DataFrame, compiled) -> DataFrame:
    rules = compiled.rule_table(hits.sparkSession).select(
        "rule_ord", "severity", "message", "fix"
    )
    return hits.join(compiled.small(rules), "rule_ord")


def severity_floor(
    findings: DataFrame, level: str | None, keep: Column | None = None
) -> DataFrame:
    """Findings at or above the level, and those that ``keep`` selects anyway."""
    if level is None:
        return findings
    high = severity_rank(F.col("severity")) >= parse_floor(level)
    return findings.filter(high if keep is None else high | keep)


def ordered(findings: DataFrame) -> DataFrame:
    """Total order: path, line, then rule, pattern and match order."""
    return findings.orderBy("path", "line", *ORDER_COLUMNS)


def apply_snippet(line: Column, snippet: Column) -> Column:
    """A replacement for one line, every non-blank line of it indented like the
    old one, ending in a newline."""
    indent = F.substring(line, F.lit(1), F.length(line) - F.length(trim_start_ws(line)))
    return F.concat(
        F.array_join(
            F.transform(
                lines(snippet),
                lambda l: F.when(trim_ws(l) == "", l).otherwise(F.concat(indent, l)),
            ),
            "\n",
        ),
        F.lit("\n"),
    )
