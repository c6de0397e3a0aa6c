"""The scan job: files and rules in, a report of findings out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.severity import parse_floor
from tamis.operators.findings import (
    FINDING_COLUMNS,
    IGNORE_TOKEN,
    ORDER_COLUMNS,
    deduplicate,
    ignore_comments,
    is_ignored,
    ordered,
    severity_floor,
    with_rule_fields,
)
from tamis.operators.matching import candidate_pairs, compile_rules, evaluate_pairs
from tamis.operators.suppression import flag_suppressed, on_changed_lines
from tamis.sources.diffs import git_diff
from tamis.sources.files import allowed, from_path
from tamis.sources.rules import load_rule_set
from tamis.sources.suppressions import find_suppressions, live_suppressions


@dataclass(frozen=True)
class ScanOptions:
    path: str = "."
    rules: str | None = None
    config: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_severity: str | None = None
    baseline: str | None = None
    diff_only: bool = False
    # Unchanged files are read from the cache when a directory for it is given.
    no_cache: bool = False
    cache_dir: str | None = None
    # Number of partitions the files are spread over; 0 leaves it to Spark.
    jobs: int = 0
    suppress: tuple[str, ...] = ()
    today: str | None = None
    ignore_tokens: tuple[str, ...] = (IGNORE_TOKEN,)


@dataclass
class ScanReport:
    """Lazy result. ``judged`` has every finding above the floor with the flags
    ``ignored`` (inline comment) and ``suppressed`` (suppression entry)."""

    judged: DataFrame
    files: DataFrame
    rules_loaded: int
    warnings: list[str] = field(default_factory=list)
    cache_on: bool = False
    cache_hits: int = 0
    started: float = field(default_factory=time.time)

    @property
    def findings(self) -> DataFrame:
        return self.judged.filter("not ignored and not suppressed").select(
            *FINDING_COLUMNS, *ORDER_COLUMNS
        )

    def rows(self) -> DataFrame:
        """Findings in report order, report columns only."""
        return ordered(self.findings).select(*FINDING_COLUMNS)

    def metrics(self) -> DataFrame:
        """One row: files, rules, findings, suppressed, cache_hits."""
        dropped = F.col("ignored") | F.col("suppressed")
        none = F.lit(0).cast("bigint")
        seen = self.files.agg(F.count("*").alias("files")).select(
            "files", none.alias("findings"), none.alias("suppressed")
        )
        judged = self.judged.agg(
            F.count(F.when(~dropped, 1)).alias("findings"),
            F.count(F.when(dropped, 1)).alias("suppressed"),
        ).select(none.alias("files"), "findings", "suppressed")
        total = lambda c: F.sum(c).alias(c)
        return seen.unionByName(judged).agg(
            total("files"),
            F.first(F.lit(self.rules_loaded)).alias("rules"),
            total("findings"),
            total("suppressed"),
            F.first(F.lit(self.cache_hits)).alias("cache_hits"),
        )


def raw_findings(
    files: DataFrame,
    rules,
    ignore_tokens: tuple[str, ...] = (IGNORE_TOKEN,),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """De-duplicated findings of all rules with the inline ``ignored`` flag;
    ``carry`` names columns of the files to keep."""
    compiled = compile_rules(rules)
    rows = files.select(
        "path", "text", "lang", *carry, ignore_comments(tuple(ignore_tokens)).alias("_ignores")
    )
    hits = evaluate_pairs(candidate_pairs(rows, compiled), compiled)
    flagged = hits.select(
        "path",
        *carry,
        F.col("lang").alias("language"),
        "rule_id",
        "line",
        "col",
        "snippet",
        *ORDER_COLUMNS,
        is_ignored(F.col("_ignores"), F.col("rule_id"), F.col("line")).alias("ignored"),
    )
    return with_rule_fields(deduplicate(flagged), compiled)


def judge(
    findings: DataFrame,
    *,
    min_severity: str | None = None,
    suppressions: list = (),
    root: str = "",
    changed: DataFrame | None = None,
) -> DataFrame:
    """Changed lines, severity floor and suppressions, in that order."""
    if changed is not None:
        findings = on_changed_lines(findings, changed)
    findings = severity_floor(findings, min_severity, keep=F.col("ignored"))
    return flag_suppressed(findings, list(suppressions), root)


def scan_files(
    files: DataFrame,
    rules,
    *,
    min_severity: str | None = None,
    suppressions: list = (),
    root: str = "",
    changed: DataFrame | None = None,
    ignore_tokens: tuple[str, ...] = (IGNORE_TOKEN,),
) -> ScanReport:
    """Scan a file relation (path, text, lang, n_bytes)."""
    if min_severity is not None:
        parse_floor(min_severity)
    compiled = compile_rules(rules)
    found = raw_findings(files, compiled, ignore_tokens)
    judged = judge(
        found, min_severity=min_severity, suppressions=suppressions, root=root, changed=changed
    )
    return ScanReport(judged, files, len(compiled.rules), list(compiled.warnings))


def scan(spark: SparkSession, options: ScanOptions) -> ScanReport:
    """Scan a directory tree or a single file."""
    if options.min_severity is not None:
        parse_floor(options.min_severity)
    files = from_path(spark, options.path)
    rule_set = load_rule_set(options.rules, options.config)
    live, expired = live_suppressions(
        find_suppressions(options.path, options.suppress), options.today
    )
    changed = None
    if options.diff_only and options.baseline:
        changed = git_diff(spark, options.path, options.baseline)
    files = allowed(files, options.path, options.include, options.exclude)
    if options.jobs:
        files = files.repartition(options.jobs)
    compiled = compile_rules(rule_set)
    use_cache = bool(options.cache_dir) and not options.no_cache and changed is None
    if use_cache:
        from tamis.plans.incremental import incremental_findings, tidy_cache

        cached = incremental_findings(files, compiled, options.cache_dir, options.ignore_tokens)
        found, n_hits = cached.findings, cached.cache_hits
        tidy_cache(spark, options.cache_dir)  # the findings go on reading the version they know
    else:
        found, n_hits = raw_findings(files, compiled, options.ignore_tokens), 0
    judged = judge(
        found,
        min_severity=options.min_severity,
        suppressions=live,
        root=options.path,
        changed=changed,
    )
    warnings = [*compiled.warnings, *expired]
    return ScanReport(judged, files, len(compiled.rules), warnings, use_cache, n_hits)
