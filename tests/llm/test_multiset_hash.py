"""Fingerprints against sums by hand, and the edited texts against brute force."""

import hashlib

import numpy as np
import pytest

from tamis.llm import multiset_hash as M
from tamis.llm.queries import op11_multiset_hash
from tamis.llm.tables import table


def expected(docs):
    """{(doc_id, n_chars, sha)} with texts of rows that follow each other by id."""
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[: len(text) - half] + other[:half], other))
    return out


def check(found, docs):
    for r, (doc_id, text, edited, other) in zip(sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), expected(docs), strict=True):
        assert (r["doc_id"], r["n_chars"]) == (doc_id, len(text))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (M.vectors([x]) for x in (text, edited, other))
        assert [r["fingerprint"], r["edited_fingerprint"]] == M.hex_of(np.concatenate([a, b]))
        assert r["near_edited"] == pytest.approx(M.likeness(a, b)[0]) and r["near_next"] == pytest.approx(M.likeness(a, c)[0])


def plain_vector(text):
    """The vector of one text, a paragraph and a shingle at a time."""
    import xxhash

    total = np.zeros(M.WIDTH, np.int64)
    for line in text.encode().split(b"\n"):
        total[: M.EXACT] += np.frombuffer(hashlib.blake2b(line).digest(), "<u4").astype(np.int64)
        words = [xxhash.xxh64_intdigest(w) for w in line.split()]
        for i in range(max(len(words) - M.WORDS + 1, 1) if words else 0):
            h = np.array([min(len(words), M.WORDS)], np.uint64)
            for w in words[i : i + M.WORDS]:
                h = M._mixed(h + np.array([w], np.uint64))
            lanes = np.concatenate([M._mixed(h + np.uint64(j + 1)) for j in range(M.SKETCH // 64)])
            total[M.EXACT :] += 2 * np.unpackbits(lanes.view(np.uint8)).astype(np.int64) - 1
    return (total % (1 << 32)).astype(np.uint32)


def test_vectors_are_sums_over_paragraphs():
    texts = ["a b c d\n\ne f\ng", "", "\n", "one", "x y z", "é ü\n" * 50, "w " * 70_000, "   "]
    found = M.vectors([*texts, None])
    for text, v in zip(texts, found):
        assert (v == plain_vector(text)).all()
    assert not found[-1].any()


def test_order_insertion_and_deletion():
    lines = [f"line number {i} of the text" for i in range(9)]
    of = lambda x: M.hex_of(M.vectors(["\n".join(x)]))[0]
    assert of(lines) == of(lines[::-1]) != of([*lines, lines[0]])
    assert M.inserted(of(lines[2:]), lines[:2]) == of(lines)
    assert M.deleted(of(lines), lines[4:6]) == of(lines[:4] + lines[6:])
    assert M.likeness(M.of_hex([of(lines)]), M.of_hex([of(lines[::-1])]))[0] == 1


def test_documents_of_the_table(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    found = op11_multiset_hash(spark, data).collect()
    check(found, docs)
    assert np.mean([r["near_edited"] for r in found]) > np.mean([r["near_next"] for r in found]) + 0.3


def test_odd_rows(spark, odd_docs):
    found = M.fingerprints(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    once = odd_docs.dropDuplicates(["doc_id", "text"])
    check(M.fingerprints(once).collect(), [(r["doc_id"], r["text"]) for r in once.collect()])
    # repeated rows follow each other, so one of the two is followed by its like
    twice = [r for r in found if r["doc_id"] == 5]
    assert len({r["fingerprint"] for r in twice}) == 1 and max(r["near_next"] for r in twice) == 1


def test_many_rows_of_one_id(spark):
    texts = [f"text {i}\nof no id" for i in range(300)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    found = M.fingerprints(docs).collect()
    assert sorted(r["fingerprint"] for r in found) == sorted(M.hex_of(M.vectors(texts)))
    # every text is the next one of exactly one
    following = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in texts for b in texts}
    assert {r["edited_sha256"] for r in found} <= following


def test_one_and_no_document(spark):
    schema = "doc_id long, text string"
    assert M.fingerprints(spark.createDataFrame([], schema)).count() == 0
    check(M.fingerprints(spark.createDataFrame([(3, "abc def")], schema)).collect(), [(3, "abc def")])
    check(M.fingerprints(spark.createDataFrame([(3, None)], schema)).collect(), [(3, None)])
