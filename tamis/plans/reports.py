"""Reports as tables of text lines.

A report is a DataFrame (order columns, text) that is sorted and written by
all tasks; its part files, read in order, are the document. No report is ever
put together in one row, one task or on the driver. Separators and totals need
the findings several times; they are settled first, so the input is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import tamis
from tamis.functions.severity import report_level, security_score
from tamis.functions.text import xml_escape
from tamis.operators.findings import FINDING_COLUMNS, ORDER_COLUMNS
from tamis.plans.settle import settled

TOOL = "tamis"
_KEY = ("path", "line", *ORDER_COLUMNS)
_ORDER = ("part", *_KEY, "sub")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Findings and files by severity, language and rule with all subtotals.
    ``level`` tells which of the three a row sums over: 0 none, 1 the rules, 3
    also the languages, 7 everything; summed columns are null."""
    return findings.rollup("severity", "language", "rule_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("findings"),
        F.countDistinct("path").alias("files"),
    )


def _json_object(*cols: str | Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _lines(df: DataFrame, part: int, sub: int, text: Column) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), *_KEY, F.lit(sub).alias("sub"), text.alias("text")
    )


def _fixed(findings: DataFrame, part: int, text: str | Column, keep: Column | None = None) -> DataFrame:
    one = findings.sparkSession.range(1)
    if keep is not None:
        one = one.filter(keep)
    keys = [F.lit(None).cast(findings.schema[k].dataType).alias(k) for k in _KEY]
    text = F.lit(text) if isinstance(text, str) else text
    return one.select(F.lit(part).alias("part"), *keys, F.lit(0).alias("sub"), text.alias("text"))


def _separated(df: DataFrame, key: Column, text: Column) -> Column:
    """A comma in front of all elements but the first in report order."""
    first = df.agg(F.min(key)).scalar()
    return F.concat(F.when(key == first, "").otherwise(","), text)


def _sorted(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*_ORDER).select("text")


def json_report(findings: DataFrame) -> DataFrame:
    """An array of findings, one per line."""
    findings = settled(findings)
    key = F.struct(*_KEY)
    item = _separated(findings, key, _json_object(*FINDING_COLUMNS))
    return _sorted(
        [_fixed(findings, 0, "["), _lines(findings, 1, 0, item), _fixed(findings, 2, "]")]
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """The result records of a SARIF report, flat."""
    return findings.select(
        "rule_id",
        report_level(F.col("severity")).alias("level"),
        "message",
        F.col("path").alias("uri"),
        F.col("line").alias("start_line"),
        (F.col("col") + 1).alias("start_column"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Each rule once, with what its first finding says."""
    first = F.min_by(F.struct("message", "severity"), F.struct(*_KEY)).alias("f")
    return (
        findings.groupBy("rule_id")
        .agg(first, F.min(F.struct(*_KEY)).alias("key"))
        .select(
            "rule_id",
            F.col("f.message").alias("message"),
            report_level(F.col("f.severity")).alias("level"),
            security_score(F.col("f.severity")).alias("security_severity"),
            *[F.col(f"key.{k}").alias(k) for k in _KEY],
        )
    )


def sarif_report(findings: DataFrame) -> DataFrame:
    findings = settled(findings)
    text = lambda c: F.struct(F.col(c).alias("text"))
    key = F.struct(*_KEY)
    rules = sarif_rules(findings)
    rule = _json_object(
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        text("message").alias("shortDescription"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(F.col("security_severity").alias("security-severity")).alias("properties"),
    )
    region = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"))
    location = F.struct(
        F.struct(
            F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")
        ).alias("physicalLocation")
    )
    result = _json_object(
        F.col("rule_id").alias("ruleId"),
        report_level(F.col("severity")).alias("level"),
        text("message").alias("message"),
        F.array(location).alias("locations"),
    )
    head = (
        f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
        f'{{"name":"{TOOL}","version":"{tamis.__version__}","rules":['
    )
    return _sorted(
        [
            _fixed(findings, 0, head),
            _lines(rules, 1, 0, _separated(rules, key, rule)),
            _fixed(findings, 2, ']}},"results":['),
            _lines(findings, 3, 0, _separated(findings, key, result)),
            _fixed(findings, 4, "]}]}"),
        ]
    )


def junit_suites(findings: DataFrame) -> DataFrame:
    """(path, tests, failures) per file with findings."""
    return findings.groupBy("path").agg(
        F.count("*").alias("tests"), F.count("*").alias("failures")
    )


def junit_report(findings: DataFrame) -> DataFrame:
    findings = settled(findings)
    total = findings.agg(F.count("*")).scalar()
    x = lambda c: xml_escape(F.col(c))
    suites = junit_suites(findings).select(
        "path",
        "tests",
        F.lit(-1).alias("line"),
        *[F.lit(None).cast("int").alias(k) for k in ORDER_COLUMNS],
    )
    # A suite's closing tag sorts behind its last finding.
    ends = suites.withColumn("line", F.lit(2**31 - 1))
    empty = F.lit('errors="0" time="0"')
    opening = F.concat(
        F.lit('  <testsuite name="'), x("path"), F.lit('" tests="'), F.col("tests"),
        F.lit('" failures="'), F.col("tests"), F.lit('" '), empty, F.lit(">"),
    )
    case = F.concat(
        F.lit('    <testcase classname="'), x("path"), F.lit('" name="'), x("rule_id"),
        F.lit(":"), F.col("line"), F.lit('" time="0">\n      <failure type="'), x("severity"),
        F.lit('" message="'), x("message"), F.lit('">'), x("message"), F.lit("\n"),
        x("snippet"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("fix: "), x("fix"), F.lit("\n")), F.lit("")),
        F.lit("</failure>\n    </testcase>"),
    )
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="{TOOL}" tests="'),
        F.greatest(total, F.lit(1)), F.lit('" failures="'), total, F.lit('" '), empty, F.lit(">"),
    )
    placeholder = (
        f'  <testsuite name="{TOOL}" tests="1" failures="0" errors="0" time="0">\n'
        f'    <testcase classname="{TOOL}" name="no findings" time="0"/>\n  </testsuite>'
    )
    return _sorted(
        [
            _fixed(findings, 0, head),
            _fixed(findings, 1, placeholder, keep=total == 0),
            _lines(suites, 2, 0, opening),
            _lines(findings, 2, 1, case),
            _lines(ends, 2, 2, F.lit("  </testsuite>")),
            _fixed(findings, 3, "</testsuites>"),
        ]
    )


def finding_line(width: int = 0) -> Column:
    """Display form of a finding; ``width`` of 0 shows whole snippets."""
    snippet = F.left(F.col("snippet"), F.lit(width)) if width else F.col("snippet")
    return F.format_string("%s:%d [%s] %s - %s", "path", "line", "severity", "rule_id", snippet)


def table_report(findings: DataFrame, width: int = 0) -> DataFrame:
    findings = settled(findings)
    total = findings.agg(F.count("*")).scalar()
    head = F.when(total == 0, f"{TOOL}: no findings").otherwise(
        F.concat(F.lit(f"{TOOL}: "), total, F.lit(" finding(s)"))
    )
    return _sorted([_fixed(findings, 0, head), _lines(findings, 1, 0, finding_line(width))])


def evidence_lines(findings: DataFrame) -> DataFrame:
    """One JSON object per finding for other tools."""
    text = F.to_json(F.struct(F.col("rule_id").alias("rule"), "path", "line", "snippet"))
    return findings.orderBy(*_KEY).select(text.alias("text"))


FORMATS = {
    "json": json_report,
    "sarif": sarif_report,
    "junit": junit_report,
    "table": table_report,
}


def write_report(report: DataFrame, out: str) -> None:
    """Part files under ``out``; concatenated in name order they are the report."""
    report.write.mode("overwrite").text(out)
