"""Shapes that grow: many functions in one file, one weakness class, subtotals."""

import time
from collections import Counter
from itertools import accumulate

from tamis.functions.text import running_sum
from tamis.operators.matching import find_matches
from tamis.operators.coverage import coverage_gaps
from tamis.plans.reports import findings_rollup
from tamis.plans.scan import raw_findings
from tamis.sources.rules import Flow, Rule

FLOW = Rule("flow", ("generic",), "ERROR", "m", flow=Flow(("read()",), ("execute(...)",), ("clean(...)",)))


def _lines(files, n):
    text = "".join(f"def f{i}(a):\n    execute(a)\n\nx = read()\nexecute(x)\n" for i in range(n))
    start = time.perf_counter()
    found = sorted(r["line"] for r in raw_findings(files(("many.py", text)), [FLOW]).collect())
    return found, time.perf_counter() - start


def test_many_functions_in_one_file(files):
    _lines(files, 10)
    found, _ = _lines(files, 300)
    # the lines below a def belong to it while they are blank or deeper
    assert found == sorted(x for i in range(300) for x in (5 * i + 2, 5 * i + 5))
    many, seconds = _lines(files, 1500)
    assert len(many) == 3000 and many[-1] == 7500
    assert seconds < 60


def test_gaps_of_one_large_class(spark):
    rows = [(f"CVE-{i:05d}", float(i % 97), ["CWE-1"] if i % 3 else ["CWE-1", f"CWE-{2 + i % 5}"]) for i in range(3000)]
    cves = spark.createDataFrame(rows, "id string, score double, cwes array<string>")
    corpus = spark.createDataFrame([("r", "CWE-3")], "rule_id string, cwe string")
    found = {r["cwe"]: (r["n_cves"], r["examples"]) for r in coverage_gaps(cves, corpus).collect()}
    expected = {}
    for cwe, n in Counter(c for r in rows for c in r[2]).items():
        best = sorted((-s, i) for i, s, cs in rows if cwe in cs)[:3]
        expected[cwe] = (n, [i for _, i in best])
    del expected["CWE-3"]
    assert found == expected


def test_no_gaps(spark):
    cves = spark.createDataFrame([], "id string, score double, cwes array<string>")
    assert coverage_gaps(cves, spark.createDataFrame([], "rule_id string, cwe string")).count() == 0


def test_subtotals(spark):
    rows = [("ERROR", "go", "a", "p"), ("ERROR", "go", "a", "p"), ("ERROR", "go", "b", "p"), ("ERROR", "ruby", "a", "q"), ("INFO", "go", "c", "p")]
    found = {(r["level"], r["severity"], r["language"], r["rule_id"]): (r["findings"], r["files"])
             for r in findings_rollup(spark.createDataFrame(rows, "severity string, language string, rule_id string, path string")).collect()}
    assert found[7, None, None, None] == (5, 2)
    assert found[3, "ERROR", None, None] == (4, 2) and found[3, "INFO", None, None] == (1, 1)
    assert found[1, "ERROR", "go", None] == (3, 1) and found[0, "ERROR", "go", "a"] == (2, 1)
    assert len(found) == 1 + 2 + 3 + 4


def test_many_matches_on_one_line(files):
    """Columns of 5,000 matches on a line of 55 KB; each finding carries the line."""
    n = 5000
    pack = [Rule("x", ("generic",), "INFO", "m", ("é=x(",))]
    start = time.perf_counter()
    found = find_matches(files(("one.txt", "é=x( 12 3 " * n)), pack, captures=False)
    cols = [r["col"] for r in found.select("col").orderBy("col").collect()]
    assert cols == [11 * i for i in range(n)]
    assert time.perf_counter() - start < 60


def test_running_sums(spark):
    arrays = [[], [5], list(range(255)), [1] * 256, [2] * 257, list(range(-500, 700)), None]
    df = spark.createDataFrame([(a,) for a in arrays], "v array<int>")
    found = [r[0] for r in df.select(running_sum(df["v"])).collect()]
    assert found == [list(accumulate(a or [])) for a in arrays]
