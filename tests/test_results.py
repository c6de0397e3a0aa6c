import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from tamis.operators import coverage as K
from tamis.operators.matching import compile_rules
from tamis.operators.triage import outermost_object, patched_files, triage, verified
from tamis.plans import reports
from tamis.plans.incremental import incremental_findings, rules_hash
from tamis.plans.rule_test import read_fixtures, rule_test, rule_test_totals
from tamis.plans.scan import ScanOptions, raw_findings, scan, scan_files
from tamis.sources.records import read_findings
from tamis.sources.rules import Rule, default_rule_dir, load_rule_set
from tamis.streaming.scan_stream import match_stream, scan_stream, text_stream

RULES = [
    Rule("k", ("generic",), "ERROR", 'say "k" & <go>', ("k",), fix="drop 'it'"),
    Rule("z", ("generic",), "odd", "z", ("z",)),
]


@pytest.fixture
def findings(files):
    return scan_files(files(("b.txt", "z\nk z <k>"), ("a.txt", "k")), RULES).findings


def text(df):
    return "\n".join(r.text for r in df.collect())


def test_json_report_round_trip(findings, spark, tmp_path):
    doc = json.loads(text(reports.json_report(findings)))
    assert [(f["path"], f["line"], f["rule_id"]) for f in doc] == [
        ("a.txt", 1, "k"), ("b.txt", 1, "z"), ("b.txt", 2, "k"), ("b.txt", 2, "z"),
    ]
    assert doc[1]["fix"] is None
    out = str(tmp_path / "out")
    reports.write_report(reports.json_report(findings), out)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert json.loads("".join(p.read_text() for p in parts)) == doc
    assert read_findings(spark, out).count() == 4
    (tmp_path / "r.json").write_text(json.dumps({"results": doc}, indent=1))
    assert read_findings(spark, str(tmp_path / "r.json")).count() == 4
    assert json.loads(text(reports.json_report(findings.filter("false")))) == []


def test_sarif(findings):
    run = json.loads(text(reports.sarif_report(findings)))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["k", "z"]
    assert run["tool"]["driver"]["rules"][1]["properties"]["security-severity"] == "3.0"
    region = run["results"][3]["locations"][0]["physicalLocation"]["region"]
    assert region == {"startLine": 2, "startColumn": 3} and run["results"][3]["level"] == "note"


def test_junit(findings):
    doc = xml.dom.minidom.parseString(text(reports.junit_report(findings)))
    suites = doc.getElementsByTagName("testsuite")
    assert [(s.getAttribute("name"), s.getAttribute("tests")) for s in suites] == [("a.txt", "1"), ("b.txt", "3")]
    failure = doc.getElementsByTagName("failure")[0]
    assert failure.getAttribute("message") == 'say "k" & <go>'
    assert failure.firstChild.data == "say \"k\" & <go>\nk\nfix: drop 'it'\n"
    empty = xml.dom.minidom.parseString(text(reports.junit_report(findings.filter("false"))))
    assert empty.getElementsByTagName("testcase")[0].getAttribute("name") == "no findings"
    assert empty.documentElement.getAttribute("tests") == "1"


def test_table_and_evidence(findings):
    assert text(reports.table_report(findings)).splitlines()[:2] == ["tamis: 4 finding(s)", "a.txt:1 [ERROR] k - k"]
    assert text(reports.table_report(findings.filter("false"))) == "tamis: no findings"
    assert json.loads(text(reports.evidence_lines(findings)).splitlines()[0])["rule"] == "k"


def record(cid, cwe, score, metric="cvssMetricV31", lang="en"):
    return (json.dumps({"cve": {
        "id": cid, "published": "2024-01-02T00:00", "descriptions": [{"lang": lang, "value": " One. Two."}],
        "metrics": {metric: [{"cvssData": {"baseScore": score, "baseSeverity": "high"}}]} if metric else {},
        "weaknesses": [{"description": [{"lang": "en", "value": c} for c in cwe]}]}}),)


def test_coverage(spark):
    feed = [record(f"C{i}", ["CWE-1"], float(i)) for i in range(5)]
    feed += [record("D", ["CWE-2", "CWE-1", "noinfo"], 9.0, "cvssMetricV2", "es"), record("E", [], 0, None), record("D", ["CWE-2"], 9.0)]
    cves = K.parse_feed(spark.createDataFrame([*feed, ("{bad",)], "json string"))
    assert cves.count() == 7
    e = cves.filter("id = 'E'").first()
    assert (e.score, e.severity, e.cwes, e.desc, e.published) == (0.0, "", [], "One", "2024-01-02")
    rules = compile_rules([Rule(f"r{i}", ("go",), "INFO", "m", ("x",), metadata={"cwe": "CWE-2"}) for i in range(6)]
                          + [Rule("no", ("go",), "INFO", "m", ("x",))]).rule_table(spark)
    corpus = K.rule_cwes(rules)
    gap = K.coverage_gaps(cves, corpus).first()
    assert gap.cwe == "CWE-1" and gap.examples[-1] in ("C3", "C2") and len(gap.examples) == 3
    covered = K.covered_classes(cves, corpus).first()
    assert (covered.rules, covered.more) == (["r0", "r1", "r2", "r3"], True)
    status = {r.id: r.coverage for r in K.with_coverage(cves, corpus).collect()}
    assert (status["D"], status["C1"], status["E"]) == ("covered", "GAP", "n/a")
    assert [r.id for r in K.by_score(cves, 2).collect()] == ["D", "C4"]
    s = K.coverage_summary(cves, corpus, rules).first()
    assert (s.cves, s.observed_cwes, s.covered_cwes, s.gap_cwes, s.rules, s.rules_with_cwe) == (7, 2, 1, 1, 7, 6)


def test_triage_and_fixes(files, spark):
    f = files(("a.py", "x\n  eval(k)\nz"), ("b.py", "k k"))
    found = raw_findings(f, RULES[:1])
    scores = {r.path: (r.is_tp, r.confidence) for r in triage(found).collect()}
    assert scores == {"a.py": (True, 0.9), "b.py": (False, 0.4)}
    fixes = found.select("path", "line", F.when(F.col("path") == "a.py", "no()\n\nno()").otherwise("k").alias("fixed_snippet"))
    patched = patched_files(f, fixes)
    assert patched.filter("path = 'a.py'").first().text == "x\n  no()\n\n  no()\nz"
    after = raw_findings(patched, RULES[:1], carry=("patched_line",))
    assert [r.path for r in verified(found, after).collect()] == ["a.py"]
    df = spark.createDataFrame([('say {"a": {"b": 1}} ok',), ('{"a": 1}',), ("none",)], "t string")
    assert [r[0] for r in df.select(outermost_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', '{"a": 1}', None]


def test_bundled_rules_have_fixtures_and_pass(spark):
    rules = load_rule_set()
    results = rule_test(read_fixtures(spark, default_rule_dir()), rules)
    totals = rule_test_totals(results).first()
    assert (totals.tested, totals.failed, totals.unknown) == (2 * len(rules), 0, 0)
    wrong = spark.createDataFrame([("k", "fail.txt", "x"), ("k", "pass.txt", "k"), ("q", "fail", "k")], "rule_id string, file_name string, text string")
    assert tuple(rule_test_totals(rule_test(wrong, RULES)).first()) == (2, 2, 1)


def test_incremental_scan(spark, files, tmp_path):
    cache, tokens = str(tmp_path / "c"), ("tamis-ignore",)
    run = lambda rules, *fs: incremental_findings(files(*fs), rules, cache, tokens)
    key = lambda c: sorted((r.path, r.line, r.ignored, r.message) for r in c.findings.collect())
    a, b = ("a", "k # tamis-ignore"), ("b", "none")
    first = run(RULES[:1], a, b)
    assert (first.cache_hits, first.rescanned) == (0, 2)
    second = run(RULES[:1], a, b)
    assert (second.cache_hits, second.rescanned) == (2, 0) and key(second) == key(first)
    third = run(RULES[:1], a, ("b", "k"), ("n", "k"))
    assert (third.cache_hits, third.rescanned) == (1, 2)
    assert [k[0] for k in key(third)] == ["a", "b", "n"]
    assert run(RULES[:1], ("b", "none")).findings.count() == 0
    edited = [Rule("k", ("generic",), "ERROR", "new", ("k",))]
    assert rules_hash(edited) != rules_hash(RULES[:1])
    fourth = run(edited, a)
    assert fourth.cache_hits == 0 and key(fourth)[0][3] == "new"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "k\nz" if i % 3 else "none") for i in range(30)], "id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    files = text_stream(spark, str(tmp_path / "in"), "id long, text string", F.expr("id || '.txt'"), F.col("text"))
    out = str(tmp_path / "out")
    for _ in range(2):
        scan_stream(files, RULES, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 40
    hits = match_stream(files, RULES).writeStream.format("memory").queryName("hits").start()
    hits.processAllAvailable()
    hits.stop()
    assert spark.table("hits").count() == 40


def test_stream_scan_reads_a_table_of_many_files(spark, tmp_path):
    from tamis.catalog.results import stream_scan

    text = 'x\ntoken = "0123456789abcdef0123"\n'
    docs = spark.createDataFrame([(i, text if i % 2 else "none", "web") for i in range(10)], "doc_id long, text string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    docs.filter("doc_id % 2 = 0").write.parquet(str(tmp_path / "clean/documents.parquet"))
    found = [(r["path"], r["line"]) for r in stream_scan(spark, str(tmp_path / "many")).collect()]
    assert sorted(found) == [(f"docs/web/{i}.txt", 2) for i in range(1, 10, 2)]
    assert stream_scan(spark, str(tmp_path / "clean")).collect() == []


def test_scan_of_a_directory(spark, tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content.encode() if isinstance(content, str) else content)

    put("rules/k.yaml", 'id: k\nlanguages: [generic]\nseverity: WARNING\nmessage: m\npattern: kk\n')
    put("r/a b%2B+.txt", "kk")
    put("r/.env", "kk")
    put("r/.github/w.yml", "kk")
    put("r/.github/.deep/_x", "kk")
    put("r/bad.bin", b"kk \xff")
    put("r/big.odd", "kk" + "x" * 10_000_000)
    put("r/big.py", "kk" + "x" * 10_000_000)
    put("r/.gitignore", "*.log\n!keep.log\nbuild/\n/top.txt\n# c\n")
    put("r/x.log", "kk")
    put("r/keep.log", "kk")
    put("r/build/x", "kk")
    put("r/sub/top.txt", "kk")
    put("r/top.txt", "kk")
    put("r/sub/.gitignore", "*.tmp\n")
    put("r/sub/a.tmp", "kk")
    put("r/b.tmp", "kk")
    root = str(tmp_path / "r")
    report = scan(spark, ScanOptions(path=root, rules=str(tmp_path / "rules")))
    got = sorted(r.path.removeprefix(root + "/") for r in report.rows().collect())
    assert got == sorted([
        "a b%2B+.txt", ".env", ".github/w.yml", ".github/.deep/_x", "big.odd", "big.py", "keep.log", "sub/top.txt", "b.tmp",
    ])
    m = report.metrics().first()
    # unreadable files count as seen
    assert m.files == len(got) + 1 + 2 and m.rules == 1
    put("r/.tamis-suppressions.yml", "- {rule: k, path: '.github/**', reason: x}\n- {rule: k, reason: y, expires: 2020-01-01}\n")
    report = scan(spark, ScanOptions(path=root, rules=str(tmp_path / "rules"), exclude=("*.py",), cache_dir=str(tmp_path / "cache")))
    assert report.findings.count() == 6 and "expired" in report.warnings[0]
    assert report.metrics().first().suppressed == 2
    with pytest.raises(FileNotFoundError):
        scan(spark, ScanOptions(path=str(tmp_path / "none")))
    assert scan(spark, ScanOptions(path=root, rules=str(tmp_path / "rules"), min_severity="error")).findings.count() == 0


def test_command_line(spark, tmp_path, capsys):
    from tamis.cli import main

    (tmp_path / "a.py").write_text("eval(x)\n")
    (tmp_path / "requirements.txt").write_text("reqeusts==1\n")
    assert main(["scan", str(tmp_path), "--error", "--metrics"]) == 1
    out = capsys.readouterr()
    assert "py-eval-call" in out.out and "findings=1" in out.err
    assert main(["scan", str(tmp_path), "--json", "--min-severity", "error"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["rule_id"] == "py-eval-call"
    assert main(["scan", str(tmp_path), "--only", "typosquat", "--error"]) == 1
    assert "requests" in capsys.readouterr().out
    assert main(["rule", "test", str(default_rule_dir())]) == 0
    assert "0 failed" in capsys.readouterr().out


def test_stream_of_files_that_come_again(spark, tmp_path):
    from tamis.streaming.scan_stream import latest_findings, scan_stream_latest, text_stream

    out = str(tmp_path / "out")

    def deliver(folder, checkpoint, *rows):
        spark.createDataFrame(list(rows), "path string, text string").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / folder))
        files = text_stream(
            spark, str(tmp_path / folder), "path string, text string", F.col("path"), F.col("text")
        )
        query = scan_stream_latest(files, RULES[:1], out, str(tmp_path / checkpoint))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, latest_findings(spark, out).select("path", "line").collect()))

    assert deliver("in", "c", ("none", "x")) == []
    assert deliver("in", "c", ("a", "k\nk"), ("b", "k"), ("d", None)) == [("a", 1), ("a", 2), ("b", 1)]
    # delivered twice in a batch and again in a later one
    assert deliver("in", "c", ("b", "k"), ("b", "k")) == [("a", 1), ("a", 2), ("b", 1)]
    # changed, and clean
    assert deliver("in", "c", ("a", "\n\nk"), ("b", "")) == [("a", 3)]
    # back to the first text, under a new checkpoint whose ids start anew
    assert deliver("other", "new", ("a", "k\nk")) == [("a", 1), ("a", 2)]
    assert deliver("in", "c", ("b", "k")) == [("a", 1), ("a", 2), ("b", 1)]
    assert deliver("other", "new", ("a", "k")) == [("a", 1), ("b", 1)]
