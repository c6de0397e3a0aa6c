"""The report on a feed of advisories: which weakness classes rules cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators import coverage as K
from tamis.plans.settle import settled

# Where a line stands: section, heading before rows, rank, then a name.
ORDER = ["section", "is_row", "rank", "key"]
NONE = "—"  # of an advisory without classes


def _cells(*cells: Column) -> Column:
    """A row of a table; a cell keeps no line break and no bare bar."""
    plain = [F.replace(F.regexp_replace(c, r"\s+", " "), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def _rows(df: DataFrame, section: int, rank: Column, key: Column, text: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.lit(True).alias("is_row"),
        rank.cast("double").alias("rank"),
        key.alias("key"),
        text.alias("text"),
    )


def _headings(summary: DataFrame, top: int) -> DataFrame:
    """The lines in front of the rows, as far as their section has any."""
    n = lambda name: F.col(name).cast("string")
    shown = F.least(F.col("cves"), F.lit(top)) if top else F.col("cves")
    both = lambda a, word, b: F.concat(a, F.lit(word), b)
    advisories = F.concat(n("cves"), F.lit(" ("), n("critical"), F.lit(" critical, "), n("high"), F.lit(" high)"))
    by_score = F.concat(F.lit("## Advisories by score ("), shown.cast("string"), F.lit(" of "), n("cves"), F.lit(")"))
    line = F.lit
    rule = lambda columns: F.lit("|" + " --- |" * columns)
    always, some = F.lit(True), lambda name: F.col(name) > 0
    sections = [
        (0, always, [
            line("# Advisories and rules"), line(""), line("| Count | Value |"), rule(2),
            _cells(line("Advisories"), advisories),
            _cells(line("Published"), F.coalesce(both(F.col("first_day"), " to ", F.col("last_day")), line(NONE))),
            _cells(line("Weakness classes"), n("observed_cwes")),
            _cells(line("Classes with a rule"), n("covered_cwes")),
            _cells(line("Classes without a rule"), n("gap_cwes")),
            _cells(line("Rules"), both(n("rules"), ", with a class: ", n("rules_with_cwe"))),
        ]),
        (1, some("gap_cwes"), [
            line(""), line("## Classes without a rule"), line(""),
            line("| Class | Advisories | Highest scores |"), rule(3),
        ]),
        (2, some("covered_cwes"), [line(""), line("## Classes with a rule"), line("")]),
        (3, always, [
            line(""), by_score, line(""),
            line("| Advisory | Score | Severity | Classes | Coverage | Text |"), rule(6),
        ]),
    ]
    lines = [
        F.when(on, F.struct(
            F.lit(section).alias("section"), F.lit(False).alias("is_row"),
            F.lit(float(i)).alias("rank"), F.lit("").alias("key"), text.alias("text"),
        ))
        for section, on, texts in sections
        for i, text in enumerate(texts)
    ]
    return summary.select(F.explode(F.array_compact(F.array(*lines))).alias("x")).select("x.*")


def coverage_report(cves: DataFrame, corpus: DataFrame, rules: DataFrame, top: int = 40) -> DataFrame:
    """(section, is_row, rank, key, text): the lines of the report, to be sorted
    by ``ORDER``. Classes without a rule come with most advisories first, those
    with one by name, advisories with the highest score first; ``top`` of 0 lists
    all of these. An empty feed gives the counts and an empty last table.

    The feed is parsed once; no section is brought into one task."""
    cves, corpus = settled(cves), settled(corpus)
    days = cves.filter("published <> ''").agg(F.min("published").alias("first_day"), F.max("published").alias("last_day"))
    summary = K.summary_of_settled(cves, corpus, rules).select(
        "*", *[days.select(c).scalar().alias(c) for c in days.columns]
    )
    gaps = _rows(
        K.coverage_gaps(cves, corpus), 1, -F.col("n_cves"), F.col("cwe"),
        _cells(F.col("cwe"), F.col("n_cves").cast("string"), F.array_join("examples", ", ")),
    )
    more = F.when(F.col("more"), F.lit(" …")).otherwise("")
    covered = _rows(
        K.covered_classes(cves, corpus), 2, F.lit(0), F.col("cwe"),
        F.concat(F.lit("- **"), "cwe", F.lit("**: "), F.array_join("rules", ", "), more),
    )
    classes = F.when(F.size("cwes") > 0, F.array_join("cwes", ", ")).otherwise(NONE)
    listed = K.with_coverage(K.by_score(cves, top) if top else cves, corpus)
    scored = _rows(
        listed, 3, -F.col("score"), F.col("id"),
        _cells(F.col("id"), F.col("score").cast("string"), F.col("severity"), classes, F.col("coverage"), F.col("desc")),
    )
    return _headings(summary, top).unionByName(gaps).unionByName(covered).unionByName(scored)


def coverage_text(report: DataFrame) -> DataFrame:
    """The lines in order."""
    return report.orderBy(*ORDER).select("text")
