"""Command line: ``python -m tamis scan PATH``, ``python -m tamis rule test DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.coverage import parse_feed, rule_cwes
from tamis.operators.matching import compile_rules
from tamis.plans.coverage_report import coverage_report, coverage_text
from tamis.plans.reports import FORMATS, evidence_lines, write_report
from tamis.plans.rule_test import read_fixtures, rule_test, rule_test_totals
from tamis.plans.scan import ScanOptions, scan
from tamis.plans.settle import settled
from tamis.plans.supply_chain import (
    licence_report,
    licence_text,
    lookalike_report,
    lookalike_text,
)
from tamis.sources.rules import load_rule_set

_LICENCES = ("licenses", "licences")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamis", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="scan a directory")
    s.add_argument("path", nargs="?", default=".")
    kind = s.add_mutually_exclusive_group()
    for name in ("json", "sarif", "junit"):
        kind.add_argument(f"--{name}", action="store_true")
    s.add_argument("-o", "--output", help="directory for the report's part files")
    s.add_argument("--jobs", type=int, default=0, help="partitions (0 = automatic)")
    s.add_argument("--only", default="sast", choices=("sast", *_LICENCES, "typosquat", "all"))
    s.add_argument("--license-policy")
    s.add_argument("--rules")
    s.add_argument("--baseline", help="git ref to compare with")
    s.add_argument("--diff-only", action="store_true")
    s.add_argument("--metrics", action="store_true")
    s.add_argument("--evidence", action="store_true")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--cache-dir")
    s.add_argument("--offline", action="store_true", help="accepted; every check is offline")
    for name in ("config", "exclude", "include", "suppress"):
        s.add_argument(f"--{name}", action="append", default=[])
    s.add_argument("--min-severity")
    s.add_argument("--error", action="store_true", help="exit 1 when findings remain")
    c = commands.add_parser("coverage", help="report on a feed of advisories, one JSON record a line")
    c.add_argument("feed")
    c.add_argument("--rules")
    c.add_argument("--top", type=int, default=40, help="advisories listed (0 = all)")
    c.add_argument("-o", "--output", help="directory for the report's part files")
    r = commands.add_parser("rule", help="work on rules")
    r.add_argument("action", choices=("test",))
    r.add_argument("path")
    return p


def _emit(report: DataFrame, out: str | None) -> None:
    """To ``out`` in parallel, or line by line to the terminal."""
    if out:
        write_report(report, out)
        return
    for row in report.toLocalIterator():
        print(row.text)


def _supply_chain(spark: SparkSession, args, only: str, out: str | None) -> int:
    if only == "typosquat":
        found = problems = lookalike_report(spark, args.path)
        text = lookalike_text(found)
    else:
        found, problems = licence_report(spark, args.path, args.license_policy)
        text = licence_text(found)
    if args.json or out:
        text = found.select(F.to_json(F.struct("*")).alias("text"))
    _emit(text, out)
    return problems.count() if args.error else 0


def run_scan(spark: SparkSession, args) -> int:
    if args.only in (*_LICENCES, "typosquat"):
        return 1 if _supply_chain(spark, args, args.only, args.output) else 0
    options = ScanOptions(
        path=args.path,
        rules=args.rules,
        config=tuple(args.config),
        include=tuple(args.include),
        exclude=tuple(args.exclude),
        min_severity=args.min_severity,
        baseline=args.baseline,
        diff_only=args.diff_only,
        no_cache=args.no_cache,
        cache_dir=args.cache_dir,
        jobs=args.jobs,
        suppress=tuple(args.suppress),
    )
    report = scan(spark, options)
    for w in report.warnings:
        print(f"tamis: {w}", file=sys.stderr)
    # Scanned once, read by the report, the metrics and the gate.
    report.judged = settled(report.judged)
    findings = report.findings
    name = next((n for n in ("sarif", "junit", "json") if getattr(args, n)), None)
    if name is None:
        name = "json" if args.output else "table"
    # One result per run: findings first, then licences, then one exit code.
    _emit(FORMATS[name](findings), args.output)
    problems = 0
    if args.only == "all":
        out = f"{args.output}-licences" if args.output else None
        problems += _supply_chain(spark, args, "licences", out)
    if args.metrics:
        m = report.metrics().first().asDict()
        print("tamis metrics: " + " ".join(f"{k}={v}" for k, v in m.items()), file=sys.stderr)
    if args.evidence:
        for row in evidence_lines(findings).toLocalIterator():
            print(f"evidence: {row.text}", file=sys.stderr)
    if args.error:
        problems += 0 if findings.isEmpty() else 1
    return 1 if problems else 0


def run_rule_test(spark: SparkSession, path: str) -> int:
    rules = load_rule_set(path)
    for w in rules.warnings:
        print(f"tamis: {w}", file=sys.stderr)
    print(f"tamis: {len(rules)} rule(s) valid in {path}")
    results = settled(rule_test(read_fixtures(spark, path), rules))
    totals = rule_test_totals(results).first()
    for row in results.filter("not ok or not known").orderBy("rule_id", "file_name").toLocalIterator():
        why = f"expected {row.expected}, {row.hits} hit(s)" if row.known else "no such rule id"
        print(f"  {row.rule_id}/{row.file_name}: {why}")
    print(f"tamis: fixtures: {totals.tested} checked, {totals.failed} failed")
    return 1 if totals.failed else 0


def run_coverage(spark: SparkSession, args) -> int:
    rules = compile_rules(load_rule_set(args.rules)).rule_table(spark)
    cves = parse_feed(spark.read.text(args.feed), "value")
    _emit(coverage_text(coverage_report(cves, rule_cwes(rules), rules, args.top)), args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tamis").getOrCreate()
    if args.command == "rule":
        return run_rule_test(spark, args.path)
    if args.command == "coverage":
        return run_coverage(spark, args)
    return run_scan(spark, args)
