import random
import re

import pytest
from pyspark.sql import functions as F

from tamis.operators import matching as M
from tamis.operators.matching import MARK, candidate_rules, compile_rules, find_matches
from tamis.plans.scan import raw_findings, scan_files
from tamis.sources.rules import Rule
from tests.test_patterns import plain_regex


def rule(rid, *patterns, languages=("generic",), **kw):
    return Rule(rid, languages, kw.pop("severity", "ERROR"), "m", patterns, **kw)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_places_captures_and_snippets(files):
    text = "x = 1\n\té eval(y) ; eval(\n z)\r\nlast"
    hits = find_matches(files(("a.txt", text)), [rule("e", "eval($X)")])
    assert rows(hits, "line", "col", "snippet") == [
        (2, 4, "é eval(y) ; eval("),
        (2, 14, "é eval(y) ; eval("),
    ]
    assert [r.captures["X"] for r in hits.collect()] == ["y", "\n z"]


def test_leading_and_trailing_captures(files):
    f = files(("a.js", "a\nb.innerHTML = c\nd.innerHTML = e"))
    assert rows(find_matches(f, [rule("h", "$A.innerHTML = $B")]), "line", "col") == [(1, 0)]


def test_text_with_the_marker_itself(files):
    f = files(("a.txt", f"{MARK}\n{MARK}x token {MARK}"))
    assert rows(find_matches(f, [rule("t", "token")]), "line", "col") == [(2, 5)]
    found = raw_findings(f, [rule("t", "token")])
    assert rows(found, "snippet") == [(f"{MARK}x token {MARK}",)]


def test_languages(files):
    f = files(("a.py", "k"), ("a.go", "k"), ("a.xyz", "k"))
    found = raw_findings(f, [rule("p", "k", languages=("python",)), rule("g", "k", languages=("c", "generic"))])
    assert rows(found, "rule_id", "language") == [
        ("g", "generic"), ("g", "go"), ("g", "python"), ("p", "python"),
    ]


def test_pattern_not_drops_the_line_and_inside_the_file(files):
    f = files(("a.txt", "f(1)\nf(2) safe"), ("b.txt", "f(3)"))
    assert rows(raw_findings(f, [rule("n", "f($X)", pattern_not="safe")]), "path", "line") == [
        ("a.txt", 1), ("b.txt", 1),
    ]
    assert rows(raw_findings(f, [rule("i", "f($X)", pattern_inside="safe")]), "path", "line") == [
        ("a.txt", 1), ("a.txt", 2),
    ]


@pytest.mark.parametrize(
    "kw, kept",
    [
        ({"metavariable_regex": {"X": "^b"}}, ["f(b1)"]),
        ({"metavariable_regex": {"UNBOUND": "^b"}}, ["f(a20)", "f(b1)", "f(c)"]),
        ({"metavariable_regex": {"X": "("}}, []),
        ({"metavariable_comparison": "$X > 5"}, ["f(a20)", "f(c)"]),
        ({"metavariable_comparison": "$X != 1"}, ["f(a20)", "f(c)"]),
        ({"metavariable_comparison": "$Y > 5"}, ["f(a20)", "f(b1)", "f(c)"]),
        ({"metavariable_comparison": "$X ~ 5"}, ["f(c)"]),
        ({"metavariable_comparison": "$X > five"}, []),
        ({"metavariable_comparison": "$X >5"}, []),
    ],
)
def test_constraints(files, kw, kept):
    f = files(("a.txt", "f(a20)\nf(b1)\nf(c)"))
    assert [r[0] for r in rows(raw_findings(f, [rule("r", "f($X)", **kw)]), "snippet")] == kept


def test_constraints_look_at_every_match_of_a_line(files):
    f = files(("a.txt", "f(a) f(b)"))
    found = raw_findings(f, [rule("r", "f($X)", metavariable_regex={"X": "b"})])
    assert rows(found, "line", "col") == [(1, 5)]


def test_unusable_pattern_is_skipped_with_a_warning(files):
    report = scan_files(files(("a.txt", "k")), [rule("bad", "$X $X", "k")])
    assert rows(report.findings, "line") == [(1,)] and "used twice" in report.warnings[0]


def test_dedup_keeps_the_first_pattern(files):
    found = raw_findings(files(("a.txt", "xx k")), [rule("r", "k", "x")])
    assert rows(found, "line", "col", "pat_ord") == [(1, 3, 0)]


def test_candidates(files):
    f = files(("a", "EVAL sk-1"), ("b", "other"))
    rules = [rule("e", "eval($X)"), rule("s", '"sk-$X"'), rule("none", '= "')]
    assert rows(candidate_rules(f, rules), "path", "rule_id") == [
        ("a", "e"), ("a", "none"), ("a", "s"), ("b", "none"),
    ]


def random_case(rng):
    words = ["foo", "bar(", ")", "baz", "=", "é", "$X", "$Y", "...", " "]
    text = lambda n: "".join(rng.choice(["foo", "bar(", ")", "baz", "=", " ", "\n", "é", "q"]) for _ in range(n))
    patterns = []
    while len(patterns) < 12:
        p = "".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        try:
            M.compile_pattern(p)
            patterns.append(p)
        except M.PatternError:
            pass
    return patterns, [(f"{i}.txt", text(rng.randint(0, 40))) for i in range(40)]


def test_equals_brute_force(files):
    """Spark's matches against the plain regexes over all pairs."""
    patterns, texts = random_case(random.Random(7))
    want = []
    for i, p in enumerate(patterns):
        for path, text in texts:
            for m in re.finditer(plain_regex(p)[0], text):
                before = text[: m.start()]
                col = len(before[before.rfind("\n") + 1 :].encode())
                want.append((path, f"r{i}", before.count("\n") + 1, col))
    hits = find_matches(files(*texts), [rule(f"r{i}", p) for i, p in enumerate(patterns)])
    assert rows(hits, "path", "rule_id", "line", "col") == sorted(want)


def test_no_shuffle_before_findings(files):
    compiled = compile_rules([rule("a", "k")])
    hits = M.evaluate_pairs(M.candidate_pairs(files(("a", "k")), compiled), compiled)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_pathological_text_stays_linear(files):
    """Heads without an end: the plain regex needs quadratic time here."""
    text = "<script>" * 60_000
    f = files(("a.html", text), ("b.html", "x.innerHTML " * 60_000 + "="))
    rules = [rule("s", "<script>$X</script>y"), rule("h", "$A.innerHTML = $B(")]
    assert find_matches(f, rules).count() == 0
    long = files(("c.html", text + "</script>"))
    assert find_matches(long, [rule("s", "<script>$X</script>")]).count() == 1


def test_same_result_for_any_partitioning(files, spark):
    f = files(*[(f"{i}.txt", "k = 1\nk = 2") for i in range(50)])
    rules = [rule("a", "k = $V", "k"), rule("b", "= 1")]
    one = rows(raw_findings(f.coalesce(1), rules), *[F.col(c) for c in ("path", "rule_id", "line", "col")])
    many = rows(raw_findings(f.repartition(7), rules), *[F.col(c) for c in ("path", "rule_id", "line", "col")])
    assert one == many


def test_constraint_language(files):
    """Unicode and POSIX classes, the very end, {,n}; a broken regex costs its rule only."""
    f = files(("a.txt", "call(été)\ncall(abc)\ncall(abcdefgh)"))
    cases = {
        r"^\p{L}+$": [1, 2, 3], r"abc\z": [2], "^[[:alpha:]]+$": [2, 3], "^(?P<q>[a-z]){,3}$": [2],
        "(?P<q>a)(?P=q)": [], "[": [], r"^[^[:^lower:]]+$": [2, 3],
    }
    rules = [rule(f"r{i}", "call($X)", metavariable_regex={"X": r}) for i, r in enumerate(cases)]
    compiled = compile_rules(rules)
    found = rows(find_matches(f, compiled), "rule_id", "line")
    assert found == sorted((f"r{i}", n) for i, lines in enumerate(cases.values()) for n in lines)
    assert [w.split(":")[0] for w in compiled.warnings] == ["rule r4", "rule r5"]


def test_large_files_and_long_lines_are_kept(files):
    big = "x" * 10_000_010 + " token(a)"
    found = rows(find_matches(files(("big.unknown", big)), [rule("r", "token($X)")]), "path", "line", "col")
    assert found == [("big.unknown", 1, 10_000_011)]
    line = "token(" + "y" * 1000 + ")"
    assert find_matches(files(("a.txt", line)), [rule("r", "token($X)")]).first()["snippet"] == line


def test_counts_are_the_rows_of_all_matches_and_cut_no_lines(files):
    from tamis.operators.matching import count_matches, find_matches

    f = files(
        ("a.py", "aaaa f(1) f(2)\nf(safe) é.é é.é aa"), ("b.py", "f(x) aaa\nuse g"), ("c.py", None), ("d.py", "none")
    )
    packs = [
        [rule("w", "aa"), rule("p", "é.é"), rule("g", "f($X)"), rule("s", "f(2) f"), rule("i", "aa", pattern_inside="use")],
        [rule("n", "f($X)", pattern_not="safe"), rule("c", "f($X)", metavariable_regex={"X": "^[0-9]$"}), rule("w", "aa")],
    ]
    for pack in packs:
        located = find_matches(f, pack, captures=False).groupBy("rule_id", "path").count()
        assert sorted(count_matches(f, pack).select("rule_id", "path", "n").collect()) == sorted(located.collect())
    plan = count_matches(f, packs[0])._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "split(" not in plan


def test_first_matches_by_line(files):
    """Rules that ask for no capture cut lines without lambdas and find what the others find."""
    texts = [
        "f(1)\n\tf(2) f(3)\r\nrun_f(x) f(4)", "f(x)\nf(\n)\n\n", "", "no", "\n\n", "run_f(x", "é f(ü) f(x)\nrun_f(x)f(5)",
        f"{M.MARK} f(1)\nf({M.MARK}x)\nrun_f(x)", "import\n  os f(9)", "g(run_f(x))\nx" * 3, "f(1)\x0bf(2) f(3)\nf(1)",
    ]
    f = files(*((f"{i}.{ext}", t) for i, t in enumerate(texts) for ext in ("py", "go", "txt")), ("null.py", None))
    pack = [
        rule("never", "f($X)", pattern_not="run_f(x)"),
        Rule("two", ("python", "go"), "INFO", "m", ("f(", "import os")),
        Rule("inside", ("python", "generic"), "INFO", "m", ("f($X",), pattern_inside="run_$Y"),
        rule("gap", "$X\n", pattern_not="x"),
    ]
    compiled = M.compile_rules(pack)
    first = M.evaluate_pairs(M.candidate_pairs(f, compiled), compiled)
    key = ("path", "pat_ord", "line")
    every = M.find_matches(f, pack, captures=False).groupBy(*key, "snippet").agg(F.min("col").alias("col"))
    columns = [*key, "col", "snippet"]
    found = sorted(first.select(columns).collect())
    assert found == sorted(every.select(columns).collect()) and len(found) > 60
    assert "lambda" not in first._jdf.queryExecution().executedPlan().toString()
    # an exclusion with a gap is looked for in the whole text
    gap = [rule("n", "f($X)", pattern_not="f($A)x")]
    assert rows(raw_findings(files(("a", "f(1)\nf(2)\nx\nf(2)x")), gap), "line") == [(2,), (4,)]
