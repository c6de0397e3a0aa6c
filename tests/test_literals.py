"""The tree of literals against looking for each."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import re

from pyspark.sql import functions as F

from tamis.catalog.rules import large_pack
from tamis.operators.literals import ordinals, tree_regex
from tamis.operators.matching import CompiledRules, candidate_ordinals, find_matches
from tamis.sources.rules import Rule

LETTERS = "ab.é\n'\\$(𝔘"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(LETTERS, min_size=1, max_size=5), min_size=1, max_size=30), st.text(LETTERS, max_size=40))
def test_longest_literal_at_every_place(literals, text):
    # the same syntax but for code points
    regex = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), tree_regex(sorted(literals)))
    found = {m.start(): m[1] for m in re.finditer(f"(?=({regex}))", text)}
    at = {i: max((x for x in literals if text.startswith(x, i)), key=len, default=None) for i in range(len(text))}
    assert found == {i: x for i, x in at.items() if x}


@pytest.mark.parametrize("few", [0, 10**6])
def test_ordinals(spark, few):
    random.seed(2)
    word = lambda: "".join(random.choices(LETTERS, k=random.randint(1, 4)))
    wanted = [None, ("",), (), *((word(), word()) for _ in range(150)), (), None]
    texts = [None, "", *("".join(random.choices(LETTERS, k=n)) for n in (1, 2, 5, 20, 60, 4000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r["i"]: r["o"] for r in df.select("i", ordinals(F.col("text"), wanted, few).alias("o")).collect()}
    for i, text in enumerate(texts):
        hit = lambda w: w is None or "" in w or (text is not None and any(x in text for x in w))
        assert found[i] == [n for n, w in enumerate(wanted) if hit(w)]


def test_long_literals_by_their_beginning(spark):
    long = "x" * 31 + "yz"
    wanted = [(long,), ("x" * 40,), *((f"w{i}",) for i in range(100))]
    df = spark.createDataFrame([(long,), ("x" * 35,), ("w7 w77",)], "text string")
    found = [r[0] for r in df.select(ordinals(F.col("text"), wanted)).collect()]
    assert found == [[0], [1], [2 + 7, 2 + 77]]


def test_languages(spark):
    rules = [Rule(f"r{i}", (("python", "go", "generic", "ruby")[i % 4],), "INFO", "", (f"name{i}(",)) for i in range(120)]
    rules.append(Rule("any", ("python",), "INFO", "", ("$X",)))
    text = " ".join(f"name{i}(" for i in range(0, 120, 3))
    df = spark.createDataFrame([("python", text), ("other", text), (None, text)], "lang string, text string")
    found = {r[0]: r[1] for r in df.select("lang", candidate_ordinals(CompiledRules(rules), F.col("text"), F.col("lang"))).collect()}
    inside = lambda lang: [i for i in range(0, 120, 3) if i % 4 == 2 or i % 4 == {"python": 0}.get(lang)]
    assert found["other"] == found[None] == inside(None)
    assert set(inside("python")) <= set(found["python"])


def test_one_pack_finds_what_its_parts_find(spark, files):
    random.seed(4)
    pack = large_pack(300)
    parts = [pack[i : i + 50] for i in range(0, len(pack), 50)]
    texts = [(f"f{i}", "".join(random.choices([p.patterns[0] for p in pack] + ["\n", " ", "é"], k=40))) for i in range(20)]
    key = lambda df: sorted((r["rule_id"], r["path"], r["line"], r["col"]) for r in df.collect())
    whole = key(find_matches(files(*texts), pack, captures=False))
    assert whole and whole == sorted(x for part in parts for x in key(find_matches(files(*texts), part, captures=False)))
