import subprocess

import pytest
from pyspark.sql import functions as F

from tamis.functions.globs import glob_match, path_allowed
from tamis.functions.language import language_or_generic
from tamis.functions.severity import parse_floor, severity_rank
from tamis.operators.suppression import flag_suppressed, on_changed_lines
from tamis.plans.scan import raw_findings, scan_files
from tamis.sources.diffs import changed_lines, changed_lines_of_files, git_diff
from tamis.sources.rules import Rule
from tamis.sources.suppressions import (
    Suppression,
    SuppressionError,
    live_suppressions,
    parse_suppressions,
)

K = Rule("k", ("generic",), "ERROR", "m", ("k",))


def one(spark, value, fn):
    return spark.range(1).select(fn(F.lit(value))).first()[0]


@pytest.mark.parametrize(
    "glob, text, hit",
    [
        ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", False),
        ("vendor/**", "vendor/a/b", True), ("**/*.min.js", "a.min.js", True),
        ("**/*.min.js", "x/y/a.min.js", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("*", "foo/bar", False), ("run?.py", "run1.py", True), ("run?.py", "run/.py", False),
        ("a.c", "abc", False), ("*.py\n", "x.py", False), ("*", "", True),
    ],
)
def test_globs(spark, glob, text, hit):
    assert one(spark, text, lambda c: glob_match(glob, c)) is hit


@pytest.mark.parametrize(
    "path, root, include, exclude, kept",
    [
        ("/r/src/a.py", "/r", (), ("src",), False),
        ("/r/src/a.py", "/r", ("src/*.py",), (), True),
        ("/r/x/vendor/a.py", "/r", (), ("vendor/**",), False),
        ("/r2/a.py", "/r", ("/*.py",), (), False),
        ("./a.py", ".", ("a.py",), (), True),
        ("/r/a.py", "/r", ("*.js",), (), False),
    ],
)
def test_path_filters(spark, path, root, include, exclude, kept):
    assert one(spark, path, lambda c: path_allowed(c, root, include, exclude)) is kept


@pytest.mark.parametrize(
    "path, lang",
    [
        ("a/b.py", "python"), ("b.PY", "generic"), ("x/Dockerfile", "dockerfile"),
        ("my.Dockerfile", "dockerfile"), ("Dockerfile.json", "dockerfile"), ("Dockerfile.yml", "yaml"),
        ("a.hpp", "cpp"), ("a.h", "c"), ("a.tfvars", "terraform"), ("py", "generic"), (".py", "python"),
        ("a.b/c", "generic"), ("a\\Dockerfile", "dockerfile"),
    ],
)
def test_languages(spark, path, lang):
    assert one(spark, path, language_or_generic) == lang


def test_severities(spark):
    ranks = [one(spark, s, severity_rank) for s in ("critical", " Warn ", "INFO", "odd")]
    assert ranks == [3, 2, 1, 1] and parse_floor("medium") == 2
    with pytest.raises(ValueError):
        parse_floor("odd")


def test_floor_is_checked_before_scanning(files):
    with pytest.raises(ValueError):
        scan_files(files(("a", "k")), [K], min_severity="odd")


@pytest.mark.parametrize(
    "text", ["- rule: r", "- {rule: '', reason: x}", "- {rule: r, reason: x, extra: 1}",
             "- {rule: r, reason: x, expires: 2020-1-01}", "- {rule: r, reason: x, expires: 2020-13-01}"],
)
def test_bad_suppressions(text):
    with pytest.raises(SuppressionError):
        parse_suppressions(text)


def test_suppression_dates():
    entries = parse_suppressions("{rule: r, reason: x, expires: 2020-02-31}")
    assert live_suppressions(entries, "2020-02-31") == (entries, [])
    live, warnings = live_suppressions(entries, "2020-03-01")
    assert live == [] and "expired 2020-02-31" in warnings[0]


@pytest.mark.parametrize(
    "entry, left",
    [
        (Suppression("k", "x"), 0), (Suppression("k*", "x"), 0), (Suppression("other", "x"), 3),
        (Suppression("k", "x", path="a/*.txt"), 2), (Suppression("k", "x", path="deep"), 1),
        (Suppression("?", "x", line=2), 2), (Suppression("k", "x", path="b.txt", line=1), 2),
    ],
)
def test_suppression_match(files, entry, left):
    found = raw_findings(files(("a/x.txt", "k"), ("deep/b.txt", "k\nk")), [K])
    assert flag_suppressed(found, [entry]).filter("not suppressed").count() == left


IGNORES = {
    "same line": ("k # tamis-ignore", 0),
    "next line": ("// tamis-ignore-next-line\nk", 0),
    "next line does not reach further": ("# tamis-ignore-next-line\n\nk", 1),
    "own line is not the next": ("k # tamis-ignore-next-line", 1),
    "scoped": ("k # tamis-ignore(a, k)", 0),
    "scoped to others": ("k # tamis-ignore(a)", 1),
    "empty scope": ("k # tamis-ignore()", 1),
    "unterminated": ("k # tamis-ignore (a", 1),
    "no comment": ("k 'tamis-ignore'", 1),
    "word boundary": ("k # xtamis-ignore", 1),
    "dash before": ("k <!--tamis-ignore", 1),
    "html": ("k <!-- tamis-ignore -->", 0),
    "second token counts": ("k # xtamis-ignore tamis-ignore", 0),
    "crlf": ("# tamis-ignore-next-line\r\nk\r\n", 0),
}


@pytest.mark.parametrize("name", IGNORES)
def test_inline_ignores(files, name):
    text, left = IGNORES[name]
    report = scan_files(files(("a.txt", text)), [K])
    assert report.findings.count() == left
    assert report.metrics().first().suppressed == 1 - left


def test_changed_lines(spark):
    diff = (
        "diff --git a/x b/x\n+++ b/src/x.py\n@@ -1,0 +2,3 @@ def f\n+a\n@@ -9 +12 @@\n+b\n"
        "+++ b/y.py\n@@ -3,2 +2,0 @@\n@@ -1 +5,1 @@\n+@@ -1 +99 @@\n"
    )
    got = changed_lines(spark.createDataFrame([(diff,)], "text string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("src/x.py", 2), ("src/x.py", 3), ("src/x.py", 4), ("src/x.py", 12), ("y.py", 5),
    ]


def test_diff_files_are_read_in_splits(spark, tmp_path):
    """A header far before its hunks, in a file of many splits."""
    text = "".join(
        f"diff --git a/f{i} b/f{i}\n+++ b/dir/f{i}.py\r\n"
        + "".join(f"@@ -{k} +{k * 10},{k % 3} @@ def\n+line {k}\n" for k in range(1, 3 + i * 40))
        for i in range(12)
    )
    (tmp_path / "a.diff").write_text(text, newline="")
    (tmp_path / "b.diff").write_text("@@ -1 +7 @@\n+++ b/only\n@@ -1 +5,1 @@\n", newline="")
    one_row = spark.createDataFrame([(text,)], "text string")
    want = {tuple(r) for r in changed_lines(one_row).collect()} | {("only", 5)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in changed_lines_of_files(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1500


def test_diff_splits_are_not_sorted(spark, tmp_path):
    """One header, a hunk in each of many splits; only a row per split meets in a window."""
    hunks = "".join(f"@@ -1 +{k} @@ def\n+{'x' * 90}\n" for k in range(1, 301))
    (tmp_path / "a.diff").write_text(f"@@ -1 +9 @@\n+++ b/long\n{hunks}")
    (tmp_path / "b.diff").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = changed_lines_of_files(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == [("long", k) for k in range(1, 301)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and plan.count("Window [") == 1


def test_git_diff(spark, tmp_path):
    def git(*args):
        who = ["-c", "user.name=n", "-c", "user.email=e@x"]
        subprocess.run(["git", "-C", str(tmp_path), *who, *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.txt").write_text("1\nx\n3\n4\n5\n")
    git("add", "."), git("commit", "-qm", "two")
    got = sorted(map(tuple, git_diff(spark, str(tmp_path), "HEAD~1").collect()))
    assert got == [("a.txt", 2), ("a.txt", 4), ("a.txt", 5)]
    for bad in ("nowhere", "--output=x"):
        with pytest.raises(RuntimeError, match="git diff failed"):
            git_diff(spark, str(tmp_path), bad)
    assert not (tmp_path / "x").exists()


def test_diff_only_matches_path_ends(files, spark):
    found = raw_findings(
        files(("r/src/a.txt", "k\nk"), ("xb.txt", "k"), ("c.txt", "k"), ("d.txt", "k"), ("e", "k")), [K]
    )
    changed = spark.createDataFrame(
        [("src/a.txt", 2), ("b.txt", 1), ("deep/c.txt", 1), ("x/d.txt", 2), ("e", 1)],
        "path string, line int",
    )
    kept = on_changed_lines(found, changed).select("path", "line").collect()
    assert sorted(map(tuple, kept)) == [("c.txt", 1), ("e", 1), ("r/src/a.txt", 2), ("xb.txt", 1)]
    none, no_changes = found.filter("false"), changed.filter("false")
    assert on_changed_lines(none, changed).count() == 0
    assert on_changed_lines(found, no_changes).count() == 0


def test_diff_only_without_broadcast(files, spark, monkeypatch):
    from tamis.operators import suppression

    monkeypatch.setattr(suppression, "BROADCAST_BYTES", -1)
    test_diff_only_matches_path_ends(files, spark)
