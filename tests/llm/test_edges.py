"""Nulls, ties, repeated rows, empty tables and clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from tamis.llm import decontaminate, language_id, packing, queries, secrets, simhash, token_files, top_k, url_filter
from tamis.llm.graph import components


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/de/x?y", "http://example.com/de", "http://a.net",
        "https://a.net/", "https://b.example.net/en/1#t", "http://example.net/en", "http://x.org/fr/", "http://xorg/fr/",
        "http://u@a.net:80/p", "ftp://a.co.uk://b/c?d#e", "http://net/x", "http://notexample.com/de/", "http://É.NET/ü",
    ]
    rows = [(i, u, "r", "v") for i, u in enumerate(urls)] + [(None, "http://a.net/", "r", "v"), (7, "https://a.net/", "r", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    found = [tuple(r) for r in url_filter.judge_urls(df).collect()]
    by = {r[0]: r[1:] for r in found}
    assert len(found) == len(rows)
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3][:2] == ("", "")
    assert by[4] == ("www.example.com", "/de/x", "example.com/de/", "block")
    assert by[5][2] is None and by[6][:3] == ("a.net", "", None)
    assert by[7] == ("a.net", "/", "net/", "block")
    assert by[8][2:] == ("example.net/en/", "allow") and by[9][2:] == ("net/", "block")
    assert by[10][2:] == ("org/fr/", "allow") and by[11][2] is None
    assert by[12][:3] == ("u@a.net:80", "/p", None) and by[13][:2] == ("a.co.uk:", "//b/c")
    assert by[14][2] == "net/" and by[15][2] is None and by[16][:3] == ("É.net", "/ü", "net/")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_reputation_generalises(spark):
    """A host that is bad throughout is blocked, also where no rule fits; a good one and a new one are not."""
    pages = [(f"h{k}.good.com", False) for k in range(40) for _ in range(5)] + [("bad.good.com", True)] * 30
    pages += [(f"x{k}.farm.org", True) for k in range(30) for _ in range(4)] + [("new.farm.org", None), ("one.good.com", True)]
    df = spark.createDataFrame(pages, "host string, bad boolean")
    low = {r["host"]: r["low"] for r in url_filter.reputations(df).collect()}
    assert low["bad.good.com"] > 0.5 and low["x3.farm.org"] > 0.5
    assert low["h1.good.com"] < 0.1 and "new.farm.org" not in low
    assert low["one.good.com"] < 0.5  # one page does not outweigh its domain


def brute_top_k(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    flat = [(i, v) for i, vs in vectors.items() for v in vs]
    for i, q in sorted(flat):
        if i % 5 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in flat if j != i and len(v) == len(q)]
            yield from ((i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1))


@pytest.mark.parametrize("bits", [1, 6])
def test_top_k(spark, bits):
    hot = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, hot) for i in range(40)] + [(100 + i, [math.sin(i * j + 1) for j in range(4)]) for i in range(60)]
    rows += [(200, None), (205, [None, 1.0]), (210, [float("nan")] * 4), (215, [float("inf"), 0.0]), (220, []), (None, hot)]
    rows += [(225, [1.0, 2.0]), (230, [-1.0, 0.5]), (100, [math.sin(j + 0.0 + 1) for j in range(4)][:4]), (0, hot)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    found = sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % 5 == 0, k=3, bits=bits).collect()))
    expected = sorted(brute_top_k(rows, 3))
    repeated = {100}  # an id with two vectors asks twice: compared apart
    assert [r for r in found if r[0] not in repeated] == [r for r in expected if r[0] not in repeated]
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k.top_k(df.where("vec_id = 200"), F.col("vec_id") % 5 == 0).count() == 0


def test_row_blocks_are_copied_to_few_parts():
    for n_blocks in (1, 3, 40, 19_532):
        for tasks in (1, 4, 200, 10_000):
            parts, groups = top_k.grid(n_blocks, tasks)
            assert 1 <= parts <= n_blocks and parts**2 <= tasks and 1 <= groups and parts * groups <= tasks


def test_top_k_in_many_blocks(spark, data, rows, monkeypatch):
    monkeypatch.setattr(top_k, "ROWS", 50)
    monkeypatch.setattr(top_k, "QUERIES", 3)
    vectors = [(r["vec_id"], r["embedding"]) for r in rows("embeddings")][:200]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect())) == sorted(brute_top_k(vectors, 4))


def test_languages(spark, odd_docs):
    labelled = spark.createDataFrame(
        [("the cat and the dog went to the house", "en"), ("der Hund und die Katze gehen nach Hause", "de"), (None, "en"), ("123", "xx"), ("x", None)],
        "text string, lang string",
    )
    model = language_id.fit(labelled)
    assert set(model.languages) == {"en", "de"}
    found = {r["doc_id"]: r for r in language_id.identify(odd_docs, model).collect()}
    for i in (0, 1, 2, 9):  # null, empty, blank, no letter
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[7]["lang_pred"] in ("en", "de") and 0 <= found[7]["score"] <= 1
    again = language_id.identify(spark.createDataFrame([("die Katze und der Hund",)], "text string"), model).first()
    assert again["lang_pred"] == "de" and not again["rejected"]
    assert language_id.fit(labelled.limit(0)) is None
    unknown = language_id.identify(odd_docs, None)
    assert unknown.where("lang_pred <> 'und' or not rejected").count() == 0
    assert language_id.identify(odd_docs.limit(0), model).count() == 0


def test_features_do_not_depend_on_parts(monkeypatch):
    text = "Grüße aus Überall, 𝔘nd ende. " * 50
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "_PART", 17)
    parts = language_id.features(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 30), (30, 10)] + [(100, i) for i in range(101, 160)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1} | {i: 5 for i in range(5, 10)} | {10: 10, 20: 10, 30: 10} | {i: 100 for i in range(100, 160)}


def test_empty_tables(spark, odd_docs, tmp_path):
    none = odd_docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack_documents(none, queries.TOKENIZER).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert secrets.digest(secrets.scan_secrets(none)).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench).where("contaminated").count() == 0
    token_files.write_token_files(none, f"{tmp_path}/t", queries.TOKENIZER)
    assert token_files.read_token_files(spark, f"{tmp_path}/t").count() == 0


def test_posterior_decides_unlisted_pages(spark):
    """Hosts on both sides of the limit, and one of which nothing is known."""
    rules = (url_filter.UrlRule("block", "com", "/bad/"), url_filter.UrlRule("allow", "com", "/good/"))
    pages = []
    for host, bad, good in (("a.x.com", 40, 0), ("b.x.com", 38, 2), ("c.y.com", 0, 40), ("d.y.com", 2, 38), ("e.z.com", 0, 0)):
        pages += [f"http://{host}/bad/{i}" for i in range(bad)] + [f"http://{host}/good/{i}" for i in range(good)]
        pages += [f"http://{host}/other/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    found = url_filter.judge_urls(df, rules).where("rule is null").select("host", "verdict").distinct().collect()
    verdict = {r["host"]: r["verdict"] for r in found}
    assert [verdict[h] for h in ("a.x.com", "b.x.com", "c.y.com", "d.y.com", "e.z.com")] == ["block", "block", "allow", "allow", "allow"]
