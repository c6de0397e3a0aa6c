import pytest

from tamis.sources.portable import looks_portable
from tamis.sources.rules import RuleError, load_rule_set, parse_rules

HEAD = "id: r\nlanguages: [python]\nseverity: ERROR\nmessage: m\n"
PORTABLE = "id: p\nlanguages: [golang, cobol]\nseverity: HIGH\nmessage: m\n"


def only(text):
    out = parse_rules(text, "f.yaml")
    assert len(out.rules) == 1, out.warnings
    return out.rules[0]


def test_native_scalars_keep_their_spelling():
    assert only(HEAD + "pattern: 0o777\n").patterns == ("0o777",)
    assert only(HEAD + "pattern: 1.10\n").patterns == ("1.10",)


def test_precedence_and_alternatives():
    both = "pattern: a\npattern-either: [{pattern: b}]\n"
    assert only(HEAD + both).patterns == ("a",)
    assert only(HEAD + "patterns: [{pattern: a}, {pattern: b}]\n").patterns == ("a", "b")


def test_native_flow_and_constraints():
    r = only(HEAD + "taint: {sources: [{patterns: [a, b]}], sinks: [{patterns: [c]}]}\n")
    assert r.flow.sources == ("a", "b") and r.positive_patterns() == ("c",)
    r = only(HEAD + "pattern: f($X)\nmetavariable-regex: {$X: '^a'}\n")
    assert r.metavariable_regex == {"X": "^a"}


@pytest.mark.parametrize(
    "text", [HEAD, "id: ' '\n" + HEAD[6:] + "pattern: a\n", HEAD.replace("[python]", "[]") + "pattern: a\n"]
)
def test_invalid_native_rules(text):
    with pytest.raises(RuleError):
        parse_rules(text)


def test_portable_conjunction():
    r = only(
        PORTABLE
        + "patterns:\n- pattern: f($X)\n- pattern-not: f(1)\n- pattern-inside: g\n"
        "- metavariable-regex: {metavariable: $X, regex: '^a'}\n"
        "- metavariable-comparison: {metavariable: $X, comparison: '> 3'}\n"
    )
    assert (r.patterns, r.pattern_not, r.pattern_inside) == (("f($X)",), "f(1)", "g")
    assert r.metavariable_regex == {"X": "^a"} and r.metavariable_comparison == "$X > 3"
    assert r.languages == ("go",) and r.severity == "ERROR"


def test_portable_flow():
    r = only(
        PORTABLE + "mode: taint\npattern-sources: [{pattern: a}, {patterns: [b, c]}]\n"
        "pattern-sinks: [{pattern-either: [{pattern: d}, e]}]\n"
    )
    assert r.flow.sources == ("a", "b", "c") and r.flow.sinks == ("d", "e")


@pytest.mark.parametrize(
    "body, reason",
    [
        ("patterns: [{pattern: a}, {pattern: b}, {pattern-not: c}]", "needs one positive pattern, has 2"),
        ("patterns: [{pattern-not: c}]", "has 0"),
        ("patterns: [{pattern: a}, {pattern-not-inside: b}]", "no native counterpart"),
        ("patterns: [{pattern: a, pattern-not: b}, {pattern-not: c}]", "given more than once"),
        ("mode: taint\npattern-sinks: [{pattern: a}]", "pattern-sources: a flow needs"),
        ("mode: x\npattern: 777", "quotes around 777"),
        ("mode: x\npattern: true", "quotes around True"),
        ("mode: x\npattern-either: []", "no alternative given"),
    ],
)
def test_portable_refusals(body, reason):
    out = parse_rules(PORTABLE + body, "f.yaml")
    assert not out.rules and reason in out.warnings[0] and "rule p left out" in out.warnings[0]


def test_portable_languages_and_detection():
    out = parse_rules(PORTABLE.replace("golang, ", "") + "mode: x\npattern: a\n")
    assert "is known" in out.warnings[0]
    assert looks_portable({"metavariable-regex": {"metavariable": "$X"}})
    assert not looks_portable({"metavariable-regex": {"X": "a"}, "patterns": [{"pattern": "a"}]})


def test_mixed_document():
    native = "\n".join("  " + line for line in HEAD.splitlines())
    text = f"-{native[1:]}\n  pattern: a\n- id: p\n  mode: taint\n  message: m\n"
    out = parse_rules(text)
    assert [r.id for r in out.rules] == ["r"] and len(out.warnings) == 1


def test_rule_set_order_and_locations(tmp_path):
    def put(name, rid):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(HEAD.replace("id: r", f"id: {rid}") + "pattern: a\n")

    for name, rid in [("a/x.yaml", "a"), ("b/y.yml", "b"), ("z.yaml", "z"), ("tests/t.yaml", "t")]:
        put(name, rid)
    assert [r.id for r in load_rule_set(tmp_path).rules] == ["z", "b", "a"]
    assert len(load_rule_set(tmp_path / "missing")) == 0
    assert [r.id for r in load_rule_set(config=[str(tmp_path / "a")]).rules] == ["a"]
    for loc in (str(tmp_path / "none"), "https://x/y", "p/ci", "git@h:r.git", "auto"):
        with pytest.raises(RuleError):
            load_rule_set(config=[loc])
