"""Licence policy over the inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import UNICODE, WS, trim_ws
from tamis.operators.inventory import eco_ord
from tamis.sources.policy import Policy

# Licence ids that are recognised.
KNOWN = (
    "MIT", "MIT-0", "X11", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "ISC", "Zlib", "BSL-1.0", "CC0-1.0", "Unlicense",
    "Unicode-3.0", "Unicode-DFS-2016", "WTFPL", "0BSD", "MPL-2.0", "EPL-2.0",
    "EUPL-1.2", "OSL-3.0", "Artistic-2.0", "NCSA", "PostgreSQL", "Python-2.0",
    "Ruby", "OFL-1.1", "LPPL-1.3c", "IJG", "libpng-2.0",
)
# Recognised ids with strong conditions.
RESTRICTIVE = (
    "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0",
    "EPL-2.0", "CDDL-1.0", "CPL-1.0", "EPL-1.0", "SSPL-1.0", "BUSL-1.1",
    "Elastic-2.0", "PolyForm-Noncommercial-1.0.0", "CC-BY-NC-4.0",
)
# Verdicts from worst to best, as reported.
VERDICTS = ("denied", "unlicensed", "unknown", "unlisted", "allowed", "unavailable")
# Of several licences to choose from, the best verdict counts.
_CHOICE_ORDER = ("allowed", "unlisted", "unknown", "denied")


def verdict_rank(verdict: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict) - 1).cast("int")


def is_problem(verdict: Column) -> Column:
    return ~verdict.isin("allowed", "unavailable")


def normalise_licence(raw: Column) -> Column:
    return trim_ws(F.regexp_replace(F.coalesce(raw, F.lit("")), f"{UNICODE}{WS}+", " "))


def _one(licence: Column, policy: Policy) -> Column:
    name = F.lower(licence)
    among = lambda ids: name.isin(*[i.lower() for i in ids]) if ids else F.lit(False)
    return (
        F.when(among(policy.deny), "denied")
        .when(among(policy.allow), "allowed")
        .when(~among((*KNOWN, *RESTRICTIVE)), "unknown")
        .otherwise("unlisted")
    )


def judge_licence(declared: Column, policy: Policy) -> Column:
    """``A OR B`` (or ``A/B``) lets the user choose, so the best side counts."""
    choices = (
        F.when(F.contains(declared, F.lit(" OR ")), F.split(declared, " OR ", -1))
        .when(
            F.contains(declared, F.lit("/")) & ~F.contains(declared, F.lit("://")),
            F.split(declared, "/", -1),
        )
        .otherwise(F.array(declared))
    )
    ranked = F.array(*[F.lit(v) for v in _CHOICE_ORDER])
    best = F.array_min(
        F.transform(choices, lambda c: F.array_position(ranked, _one(trim_ws(c), policy)))
    )
    return F.element_at(ranked, best.cast("int"))


def licence_findings(inventory: DataFrame, policy: Policy) -> DataFrame:
    """A verdict per dependency in scope."""
    declared = normalise_licence(F.col("license"))
    rows = inventory if policy.scope == "all" else inventory.filter("direct")
    unreadable = F.col("licence_availability") == "notinformat"
    if policy.unlicensed == "ignore":
        rows = rows.filter(unreadable | (declared != ""))
    return rows.select(
        F.col("name").alias("package"),
        "version",
        "ecosystem",
        F.when(unreadable, "not in this manifest format")
        .when(declared == "", "none declared")
        .otherwise(declared)
        .alias("licence"),
        F.when(unreadable, "unavailable")
        .when(declared == "", "unlicensed")
        .otherwise(judge_licence(declared, policy))
        .alias("verdict"),
        "direct",
        "manifest",
    )


def licence_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(
        verdict_rank(F.col("verdict")), eco_ord(F.col("ecosystem")), "package"
    )


def licence_summary(findings: DataFrame) -> DataFrame:
    """Counts per verdict and whether it needs a decision."""
    return (
        findings.groupBy("verdict")
        .agg(F.count("*").alias("n"))
        .withColumn("problem", is_problem(F.col("verdict")))
    )


def licence_line() -> Column:
    """Display form of a licence finding."""
    return F.format_string(
        "%s %s [%s] - %s (licence: %s)",
        "package",
        F.when(F.col("version") == "", "-").otherwise(F.col("version")),
        "ecosystem",
        "verdict",
        "licence",
    )
