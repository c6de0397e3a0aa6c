"""The report on advisories and its command."""

import json

from tamis import cli
from tamis.operators import coverage as K
from tamis.operators.matching import compile_rules
from tamis.plans.coverage_report import coverage_report, coverage_text
from tamis.sources.rules import Rule

RULES = [Rule(f"r{i}", ("generic",), "INFO", "", ("x",), metadata={"cwe": "CWE-1"}) for i in range(5)]
RULES.append(Rule("bare", ("generic",), "INFO", "", ("x",)))


def record(name, score, *cwes, text="Flaw. More", day="2024-01-02T00:00:00"):
    return json.dumps({"cve": {
        "id": name, "published": day,
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": score, "baseSeverity": "HIGH"}}]},
        "descriptions": [{"lang": "en", "value": text}],
        "weaknesses": [{"description": [{"lang": "en", "value": c} for c in cwes]}],
    }})


def report(spark, records, top=40):
    rules = compile_rules(RULES).rule_table(spark)
    cves = K.parse_feed(spark.createDataFrame([(r,) for r in records], "json string"))
    return [r.text for r in coverage_text(coverage_report(cves, K.rule_cwes(rules), rules, top)).collect()]


FEED = [
    record("B", 9.8, "CWE-1", "CWE-7"), record("A", 9.8, "CWE-7", day="2024-01-01T00:00:00"), record("A", 9.8, "CWE-7"),
    record("C", 5.0, "CWE-10"), record("D", 7.0, text="One | two\nthree"), "no json", None,
]


def test_report(spark):
    lines = report(spark, FEED)
    assert lines[0].startswith("# ") and "| Advisories | 4 (0 critical, 4 high) |" in lines
    assert "| Rules | 6, with a class: 5 |" in lines
    at = lines.index("## Classes without a rule")
    assert lines[at + 4 : at + 6] == ["| CWE-7 | 2 | A, B |", "| CWE-10 | 1 | C |"]
    assert "- **CWE-1**: r0, r1, r2, r3 …" in lines
    at = lines.index("## Advisories by score (4 of 4)")
    assert [x.split(" | ")[0] for x in lines[at + 4 :]] == ["| A", "| B", "| D", "| C"]
    assert lines[at + 6] == "| D | 7.0 | HIGH | — | n/a | One \\| two three |"
    assert lines[at + 5].split(" | ")[4] == "covered" and lines[at + 4].split(" | ")[4] == "GAP"


def test_top(spark):
    two, every = report(spark, FEED, 2), report(spark, FEED, 0)
    assert "## Advisories by score (2 of 4)" in two and len(two) == len(every) - 2
    assert every == report(spark, FEED)


def test_empty_feed(spark):
    lines = report(spark, [])
    assert "| Advisories | 0 (0 critical, 0 high) |" in lines and "| Published | — |" in lines
    assert not any("Classes with" in x and x.startswith("##") for x in lines)
    assert "## Advisories by score (0 of 0)" in lines and lines[-2].startswith("| Advisory |")


def test_command(spark, tmp_path, capsys):
    feed = tmp_path / "feed.jsonl"
    feed.write_text("\n".join(x for x in FEED if x))
    run = cli.parser().parse_args(["coverage", str(feed), "--top", "1", "-o", str(tmp_path / "out")])
    assert cli.run_coverage(spark, run) == 0
    text = spark.read.text(str(tmp_path / "out"))
    assert text.filter("value like '## Advisories by score (1 of 4)'").count() == 1
    assert cli.run_coverage(spark, cli.parser().parse_args(["coverage", str(feed)])) == 0
    assert "| A | 9.8 | HIGH | CWE-7 |" in capsys.readouterr().out
