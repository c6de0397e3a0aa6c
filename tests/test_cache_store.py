"""Upkeep of the cache: compaction, the switch of versions, retirement."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamis.plans import cache_store as S
from tamis.plans.incremental import incremental_findings, split_by_cache, tidy_cache
from tamis.sources.rules import Rule

RULES = [Rule("k", ("generic",), "ERROR", "m", ("k",)), Rule("q", ("generic",), "INFO", "m", ("q",))]


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / "c")


@pytest.fixture
def run(files, cache):
    def go(*rows, rules=RULES):
        return incremental_findings(files(*rows), rules, cache, ("tamis-ignore",))

    return go


def key(found):
    return sorted((r.path, r.line, r.rule_id) for r in found.findings.collect())


def keys(spark, folder):
    rows = S.stored_table(spark, f"{folder}/scanned", S.SCANNED).collect()
    return sorted((r.path or "", r.content_hash, r.rules_hash) for r in rows)


def test_compaction_keeps_what_runs_find(spark, cache, run):
    tree = [("a", "k\nq"), ("b", "none"), ("c", "q k"), ("d", "")]
    for i in range(3):
        run(*tree, ("new", f"k {i}"))
    before = run(*tree, ("new", "k 2"))
    expected = key(before)
    live = S.compact(spark, cache)
    assert S.live_version(spark, cache) == live != cache
    # who knew the version before goes on reading it
    assert key(before) == expected
    after = run(*tree, ("new", "k 2"))
    assert (after.cache_hits, after.rescanned) == (5, 0) and key(after) == expected
    # two contents of each path stay, the oldest one goes
    assert run(("new", "k 1")).cache_hits == 1 and run(("new", "k 0")).cache_hits == 0
    assert key(run(("new", "k 0"), ("a", "k\nq"))) == [("a", 1, "k"), ("a", 2, "q"), ("new", 1, "k")]


def test_files_stay_few(spark, cache, run):
    rewritten = 0
    for i in range(7):
        found = run(("a", "k"), (f"p{i}", "q k"))
        rewritten += tidy_cache(spark, cache, max_files=6)
        assert S.cache_files(spark, cache)[0] <= 6
        assert key(found) == [("a", 1, "k"), (f"p{i}", 1, "k"), (f"p{i}", 1, "q")]
    assert rewritten > 0
    assert run(*((f"p{i}", "q k") for i in range(7))).rescanned == 0


def test_retention(spark, cache, run, files):
    run(("a", "k"), ("gone", "k"))
    run(("a", "k"), rules=RULES[:1])
    run(("a", "k"), ("gone", "k"), rules=RULES[1:])
    only = S.Retention(rule_sets=2, paths=files(("a", "")).select("path", F.lit(1).alias("run")))
    live = S.compact(spark, cache, only)
    assert [p for p, _, _ in keys(spark, live)] == ["a", "a"]
    assert run(("a", "k")).cache_hits == 0 and run(("a", "k"), rules=RULES[1:]).cache_hits == 1
    assert S.compact(spark, cache, S.Retention(contents=0)) == S.live_version(spark, cache)
    assert run(("a", "k"), rules=RULES[1:]).cache_hits == 0


def test_key_of_two_runs_counts_once(spark):
    """Runs side by side may scan the same file."""
    rows = [("a", 1, "t1", "r"), ("a", 1, "t2", "r"), ("a", 2, "t0", "r"), (None, 3, "t1", "r"), ("a", 1, "t1", "s")]
    scanned = spark.createDataFrame(rows, S.SCANNED)
    found = S.kept_keys(scanned, S.Retention(contents=1)).collect()
    assert sorted((r.rules_hash, r.path or "", r.content_hash, r.run) for r in found) == [
        ("r", "", 3, "t1"), ("r", "a", 1, "t2"), ("s", "a", 1, "t1"),
    ]
    hits, misses = split_by_cache(spark.createDataFrame([("a", 1), ("b", 1)], "path string, content_hash long"), scanned)
    assert [tuple(r) for r in hits.collect()] == [("a", 1, "t2")] and [r.path for r in misses.collect()] == ["b"]
    assert S.kept_keys(scanned.limit(0), S.Retention()).count() == 0


def test_failed_compaction_changes_nothing(spark, cache, run, monkeypatch):
    expected = key(run(("a", "k")))
    monkeypatch.setattr(S, "FINDINGS", "no schema at all")
    with pytest.raises(Exception):
        S.compact(spark, cache)
    monkeypatch.undo()
    assert S.live_version(spark, cache) == cache
    assert key(run(("a", "k"))) == expected
    assert sum(n.startswith("data-") for n in os.listdir(cache)) == 1  # left for retire


def test_retire(spark, cache, run):
    assert S.retire(spark, cache, 0) == []
    run(("a", "k"))
    assert S.retire(spark, cache, 0) == []  # the only version
    first, second = S.compact(spark, cache), S.compact(spark, cache)
    assert S.retire(spark, cache) == []  # still in use, perhaps
    gone = S.retire(spark, cache, 0)
    assert gone == sorted([Path(first).name, "findings", "scanned"])
    assert S.live_version(spark, cache) == second
    assert run(("a", "k")).cache_hits == 1
    assert S.retire(spark, cache, 0) == []


def test_empty_cache(spark, cache, run):
    live = S.compact(spark, cache)
    assert keys(spark, live) == [] and key(run(("a", "k"))) == [("a", 1, "k")]
