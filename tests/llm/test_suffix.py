import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import queries, suffix


def brute(docs, length=100):
    """(doc_id, text) in order of id to (n_bytes, n_removed, n_spans, sha) by looking at every window."""
    seen, out = set(), []
    for doc, text in docs:
        raw, gone = (text or "").encode(), None
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i + 1 : i + 1 + length] = True
            seen.add(w)
        n_spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
        out.append((doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def check(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert digest(suffix.remove_repeats(df)) == sorted(brute(docs), key=repr)


def test_query(spark, data, rows):
    expected = brute(sorted((d["doc_id"], d["text"]) for d in rows("documents")))
    found = sorted(map(tuple, queries.op7_suffix_dedup(spark, data).collect()))
    assert found == expected
    assert sum(r[2] for r in expected) > 10000


@pytest.mark.parametrize("wide", [suffix.WIDE, 3])
def test_planted_repeats(spark, monkeypatch, wide):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passages = [word(n) for n in (99, 100, 101, 140, 400)] + ["é" * 60 + word(30)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, word(50)]
    for k in range(60):
        texts.append(word(int(rng.integers(0, 300))) + passages[k % 6] + word(int(rng.integers(0, 90))) + passages[k % 5])
    texts += texts[20:30] + [t[:150] + "X" + t[151:] for t in texts[30:40]] + [word(200) * 3]
    monkeypatch.setattr(suffix, "WIDE", wide)
    monkeypatch.setattr(suffix, "CHUNK", 256 if wide == 3 else suffix.CHUNK)
    check(spark, texts)


def test_sorted_suffixes():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[:300]
    data[2000:2200] = 97
    data[2500:2600] = 97
    starts, group = np.arange(2900), np.zeros(2900, np.int64)
    order, cls = suffix.sort_suffixes(data, starts, group, 100)
    strings = [data[i : i + 100].tobytes() for i in order]
    assert strings == sorted(strings)
    assert [a != b for a, b in zip(strings, strings[1:])] == list(np.diff(cls) != 0)


def test_odd_rows(spark, odd_docs):
    found = suffix.remove_repeats(odd_docs)
    by = {(r["doc_id"], r["n_bytes"]): r for r in found.collect()}
    assert found.count() == odd_docs.count()
    assert by[(None, 10)]["n_removed"] == 0 and by[(0, 0)]["kept"] == b""
    text = odd_docs.where("doc_id = 7").first()["text"]
    assert by[(7, len(text))]["n_removed"] == len(text) - 70
    assert by[(8, len(text) + 4)]["kept"] == b"tail" or by[(8, len(text) + 4)]["n_removed"] == len(text)
    assert found.limit(0).count() == 0


@pytest.mark.parametrize("length", [64, 129, 200, 300])
def test_other_lengths(spark, length):
    """Windows of any length are hashed whole: copies that differ in one byte
    of their middle stay."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [word(length + k) for k in range(8)]
    for k in range(8):
        at = length * (k + 1) // 10
        texts.append(texts[k][:at] + "#" + texts[k][at + 1 :])
        texts.append(word(20) + texts[k][: length + k % 2] + word(9))
    texts += [word(400) + texts[0] * 2, "a" * 900, None]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert digest(suffix.remove_repeats(df, length)) == sorted(brute(docs, length), key=repr)
