"""Lock files nested to any depth, and JSON read without recursion."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.operators.inventory import _json_of_any_depth, parse_manifests, unreadable_manifests

JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=6),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4),
    max_leaves=20,
)


def by_tokens():
    loads, _ = _json_of_any_depth()
    return next(c.cell_contents for c in loads.__closure__ if callable(c.cell_contents))


@settings(max_examples=300, deadline=None)
@given(JSON, st.sampled_from([None, 1]), st.booleans())
def test_reads_what_json_reads(value, indent, ascii_only):
    assert by_tokens()(json.dumps(value, indent=indent, ensure_ascii=ascii_only)) == value


@settings(max_examples=400, deadline=None)
@given(st.text('{}[]:,"a1 \\\n', max_size=14))
def test_refuses_what_json_refuses(text):
    try:
        expected = (json.loads(text),)
    except ValueError:
        expected = None
    try:
        found = (by_tokens()(text),)
    except ValueError:
        found = None
    assert found == expected


def nested(depth, end="}"):
    head = "".join(f'{{"version": "{i}", "dependencies": {{"d{i:05d}": ' for i in range(1, depth))
    return '{"dependencies": {"d00000": ' + head + '{"version": "last", "license": "MIT"}' + "}}" * (depth - 1) + "}" + end


@pytest.mark.parametrize("depth", [3, 500, 10_000, 60_000])
def test_every_level_is_read(spark, depth):
    files = spark.createDataFrame(
        [("a/package-lock.json", nested(depth)), ("b/requirements.txt", "flask==1.0"), ("c/package-lock.json", nested(depth, ""))],
        "path string, text string",
    )
    found = parse_manifests(files).collect()
    rows = [r for r in found if r["manifest"] == "a/package-lock.json"]
    assert len(rows) == depth and len({r["name"] for r in rows}) == depth
    assert [r["name"] for r in rows if r["direct"]] == ["d00000"]
    assert [(r["version"], r["license"]) for r in rows if r["license"]] == [("last", "MIT")]
    assert [r["name"] for r in found if r["manifest"] == "b/requirements.txt"] == ["flask"]
    assert {r["path"] for r in unreadable_manifests(files).collect()} == {"c/package-lock.json"}


def test_deep_values_beside_the_packages(spark):
    deep = "[" * 5000 + "]" * 5000
    text = f'{{"packages": {{"": {{"dependencies": {{"x": "1"}}}}, "node_modules/x": {{"version": "1.2", "license": "MIT", "odd": {deep}}}}}}}'
    files = spark.createDataFrame([("package-lock.json", text)], "path string, text string")
    assert [(r["name"], r["version"], r["license"], r["direct"]) for r in parse_manifests(files).collect()] == [("x", "1.2", "MIT", True)]
