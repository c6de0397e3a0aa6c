import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.functions.patterns import (
    PatternError,
    compile_pattern,
    flow_regex,
    index_literals,
    split_pattern,
)


def plain_regex(pattern: str) -> tuple[str, list[str]]:
    """The direct translation: lazy gaps, no anchors, no atomic groups."""
    pieces, gaps = split_pattern(pattern)
    out, names = "(?s)", []
    for i, piece in enumerate(pieces):
        out += piece.lead + piece.core + piece.trail
        if i < len(gaps):
            gap = gaps[i]
            out += gap.regex(True)
            names += [gap.name] if gap.name else []
    return out, names


def plain_matches(pattern: str, text: str):
    regex, names = plain_regex(pattern)
    return [(m.start(), m.groups()) for m in re.finditer(regex, text)]


def linear_matches(pattern: str, text: str):
    """What Spark does with the compiled pattern, in Python: search steps from
    the end of the previous match, captures from the marked place on."""
    c = compile_pattern(pattern)
    search = re.compile(c.search.replace("(?U)", "").replace("\\G", ""))
    core = re.compile(c.core.replace("(?U)", ""))
    anchored = "\\G" in c.search
    starts, pos = [], 0
    while (m := (search.match if anchored else search.search)(text, pos)) is not None:
        starts.append(m.start(2))
        pos = m.end()
    ends = [*starts[1:], len(text)]
    return [(s, core.match(text[s:e]).groups()) for s, e in zip(starts, ends)]


PIECES = ["a", "b", "(", ")", " ", "\n", "$X", "$Y", "...", "$...R", "ab", "= ", "."]


@settings(max_examples=1500, deadline=None)
@given(
    st.lists(st.sampled_from(PIECES), min_size=1, max_size=7),
    st.text(alphabet="ab() =.\n", max_size=40),
)
def test_linear_form_equals_plain_form(parts, text):
    pattern = "".join(parts)
    try:
        compile_pattern(pattern)
    except PatternError:
        return
    assert linear_matches(pattern, text) == plain_matches(pattern, text)


@pytest.mark.parametrize(
    "pattern, text, starts",
    [
        ("\\$ref: 'http://$URL'", "$ref: 'http://h'", [0]),
        ("\\$ref: 'http://$URL'", "url: 'http://h'", []),
        ("$VAR.innerHTML = $VAL", "x\ny.innerHTML = z", [0]),
        ("foo( $A , $B )", "foo(1,2)  foo( 3 ,\n4 )", [0, 10]),
        ("eval(...)", "eval() eval(x)", [0, 7]),
        ("end $...REST", "the end of it", [4]),
    ],
)
def test_matches(pattern, text, starts):
    assert [s for s, _ in linear_matches(pattern, text)] == starts


def test_trailing_capture_is_greedy_and_gap_names_lose_underscores():
    c = compile_pattern("f($...A_B, $C")
    assert c.names == ("AB_REST", "C")
    assert linear_matches("f($...A_B, $C", "f(1, 2, 3) ")[0][1] == ("1", "2, 3) ")


@pytest.mark.parametrize("pattern", ["$X = $X", "$1", "...", "  ", "$...R"])
def test_unusable_patterns(pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern)


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ('"sk-$REST"', ["sk-"]),
        ('$VAR = "SG.$REST"', ["sg."]),
        ('iv = "', []),
        ("cursor.execute($Q)", ["cursor", "execute", "cursor.execute"]),
        ("a...b", []),
        ("\\$schema", ["schema"]),
    ],
)
def test_index_literals(pattern, literals):
    assert index_literals(pattern) == literals


def test_index_literals_of_dashed_names():
    assert index_literals("+1 ($AREA) 555-") == ["555", "555-"]
    assert index_literals("left-pad.core") == ["left", "pad", "core", "left-pad", "left-pad.core"]


def test_flow_regex_swallows_dots():
    regex, words = flow_regex("request.$ANY.x(...)")
    assert regex == r"request\..*?\(.*?\)" and words == ("request.", "(", ")")
