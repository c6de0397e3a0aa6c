"""How well the rules cover the weakness classes of an advisory feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import trim_ws
from tamis.plans.settle import settled

CWE = r"CWE-\d+"
_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>"
# The parts of a feed record that are read.
FEED_RECORD = f"""
    cve struct<
      id:string, published:string,
      metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,
      descriptions:array<struct<lang:string,value:string>>,
      weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>
"""


def _cwes(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CWE})"), F.lit(1))


def parse_feed(records: DataFrame, column: str = "json") -> DataFrame:
    """(id, published, score, severity, cwes, desc) of feed records in JSON.
    Newer scores take precedence over older ones; repeated ids keep one row."""
    c = F.from_json(F.col(column), FEED_RECORD)["cve"]
    rows = records.select(c.alias("c")).filter("c.id is not null")
    first = lambda name: F.get(F.col(f"c.metrics.{name}"), F.lit(0))
    metric = F.coalesce(*[first(n) for n in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    english = F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))
    sentence = F.split(trim_ws(F.coalesce(english["value"], F.lit(""))), r"\. ", 2)
    named = F.flatten(
        F.transform(
            F.flatten(F.transform("c.weaknesses", lambda w: w["description"])),
            lambda d: _cwes(d["value"]),
        )
    )
    parsed = rows.withColumn("m", metric).select(
        "c.id",
        F.substring(F.coalesce("c.published", F.lit("")), 1, 10).alias("published"),
        F.coalesce("m.cvssData.baseScore", F.lit(0.0)).alias("score"),
        F.upper(F.coalesce("m.baseSeverity", "m.cvssData.baseSeverity", F.lit(""))).alias("severity"),
        F.array_sort(
            F.array_distinct(F.coalesce(named, F.array().cast("array<string>")))
        ).alias("cwes"),
        F.get(sentence, F.lit(0)).alias("desc"),
    )
    rest = [c for c in parsed.columns if c != "id"]
    one = F.min_by(F.struct(*rest), F.struct(*rest)).alias("r")
    return parsed.groupBy("id").agg(one).select("id", "r.*")


def rule_cwes(rules: DataFrame) -> DataFrame:
    """(cwe, rule_id) from the ``cwe`` metadata of a rule table."""
    return rules.select(
        F.explode(_cwes(F.element_at("metadata", "cwe"))).alias("cwe"), "rule_id"
    ).distinct()


def corpus_counts(rules: DataFrame) -> DataFrame:
    """One row: rules, rules_with_cwe."""
    has = F.size(_cwes(F.element_at("metadata", "cwe"))) > 0
    return rules.agg(
        F.count("*").alias("rules"), F.count(F.when(has, 1)).alias("rules_with_cwe")
    )


def observed(cves: DataFrame) -> DataFrame:
    """(cwe, id, score): every weakness class of every advisory."""
    return cves.select(F.explode(F.array_distinct("cwes")).alias("cwe"), "id", "score")


def coverage_gaps(cves: DataFrame, corpus: DataFrame, examples: int = 3) -> DataFrame:
    """Observed classes without a rule: (cwe, n_cves, examples), where examples
    are the ids with the highest score. Counts are combined and ranks limited
    before the shuffle, so that no class is brought together as a whole. The feed
    is read once."""
    gaps = settled(observed(cves).join(corpus.select("cwe").distinct(), "cwe", "left_anti"))
    counts = gaps.groupBy("cwe").agg(F.count("*").alias("n_cves"))
    by_score = Window.partitionBy("cwe").orderBy(F.desc("score"), "id")
    first = gaps.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= examples)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"])
    return counts.join(first.groupBy("cwe").agg(ids.alias("examples")), "cwe")


def gap_report(cves: DataFrame, corpus: DataFrame, examples: int = 3) -> DataFrame:
    """The gaps in report order with their place: most advisories first, then by class."""
    order = Window.orderBy(F.desc("n_cves"), "cwe")
    # One row per weakness class: as few as there are classes, whatever the feed.
    return coverage_gaps(cves, corpus, examples).withColumn("place", F.row_number().over(order))


def covered_classes(cves: DataFrame, corpus: DataFrame, shown: int = 4) -> DataFrame:
    """Observed classes with rules: (cwe, rules, more), the first ``shown`` rule
    ids in name order and whether there are others."""
    seen = observed(cves).select("cwe").distinct()
    names = Window.partitionBy("cwe").orderBy("rule_id")
    ranked = corpus.join(seen, "cwe", "left_semi").withColumn(
        "place", F.row_number().over(names)
    )
    return (
        ranked.filter(F.col("place") <= shown + 1)
        .groupBy("cwe")
        .agg(F.array_sort(F.collect_list("rule_id")).alias("found"))
        .select(
            "cwe",
            F.slice("found", 1, shown).alias("rules"),
            (F.size("found") > shown).alias("more"),
        )
    )


def with_coverage(cves: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``coverage``: covered, GAP or n/a."""
    hit = (
        observed(cves)
        .join(corpus.select("cwe").distinct(), "cwe", "left_semi")
        .groupBy("id")
        .agg(F.lit(True).alias("hit"))
    )
    return cves.join(hit, "id", "left").select(
        *cves.columns,
        F.when(F.coalesce("hit", F.lit(False)), "covered")
        .when(F.size("cwes") > 0, "GAP")
        .otherwise("n/a")
        .alias("coverage"),
    )


def by_score(cves: DataFrame, top: int = 0) -> DataFrame:
    """Highest score first; ``top`` of 0 is all."""
    ranked = cves.orderBy(F.desc("score"), "id")
    return ranked.limit(top) if top else ranked


def coverage_summary(cves: DataFrame, corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of counts for the report header. The feed is read once."""
    return summary_of_settled(settled(cves), corpus, rules)


def summary_of_settled(cves: DataFrame, corpus: DataFrame, rules: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    covered = corpus.select("cwe").distinct().withColumn("known", F.lit(True))
    classes = (
        observed(cves)
        .select("cwe")
        .distinct()
        .join(covered, "cwe", "left")
        .agg(
            F.count("*").alias("observed_cwes"),
            F.count("known").alias("covered_cwes"),
            (F.count("*") - F.count("known")).alias("gap_cwes"),
        )
    )
    counts = corpus_counts(rules)
    return cves.agg(
        F.count("*").alias("cves"), n("CRITICAL").alias("critical"), n("HIGH").alias("high")
    ).select(
        "*",
        *[classes.select(c).scalar().alias(c) for c in classes.columns],
        *[counts.select(c).scalar().alias(c) for c in counts.columns],
    )
