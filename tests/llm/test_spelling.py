"""Scans of sorted lists against comparing all words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import spelling
from tamis.llm.queries import op13_spelling_variants
from tamis.llm.tables import table


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = spelling.common(a, b)
    return a[at + 1 :] == b[at + 1 :] or a[at + 1 :] == b[at:] or a[at:] == b[at + 1 :]


def words_of(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def expected(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_words_of_the_table(spark, data):
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    found = op13_spelling_variants(spark, data).collect()
    assert sorted(map(tuple, found)) == expected(words_of(docs))


def near_in(words, chunk):
    """All pairs, by the functions that the tasks run."""
    out = []
    lists = {}
    for reverse in (False, True):
        entries = sorted(w[::-1] if reverse else w for w in words)
        lists[reverse] = [entries[i : i + chunk] for i in range(0, len(entries), chunk)]
    chunks = spelling.Chunks([(r, i, part[0], part[-1]) for r, parts in lists.items() for i, part in enumerate(parts)])
    for reverse, parts in lists.items():
        for word in words:
            key = word[::-1] if reverse else word
            for i in chunks.reached(key, reverse):
                start, part = spelling.half(key, reverse), parts[i]
                low = spelling.bisect_left(part, key[:start])
                high = spelling.bisect_left(part, key[:start] + spelling._END)
                for j in spelling.scan(key, part, spelling.shared_with_last(part), start, low, high, True):
                    near = part[j][::-1] if reverse else part[j]
                    if not reverse or spelling.common(word, near) < len(key) - start:
                        out.append((word, near))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=9), max_size=60), st.integers(1, 20))
def test_scans_of_dense_words(words, chunk):
    assert near_in(words, chunk) == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_long_common_prefixes():
    random.seed(3)
    words = {"a" * 90 + "".join(random.choices("ab", k=8)) for _ in range(120)} | {"ab" * 60, "ab" * 60 + "b", "b" + "ab" * 60}
    assert near_in(words, 7) == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_one_hot_beginning_in_many_chunks(spark):
    """A third of the words share their first letters; chunks of 16 words."""
    random.seed(5)
    words = {"prefixed" + "".join(random.choices("abcd", k=4)) for _ in range(150)}
    words |= {"".join(random.choices("abc", k=7)) for _ in range(300)}
    n = {w: 5 + i for i, w in enumerate(sorted(words))}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    found = spelling.near_words(df, chunk=16).collect()
    assert sorted(map(tuple, found)) == sorted((a, b, n[b]) for a in n for b in n if one_apart(a, b))


def test_chains_ties_and_odd_rows(spark):
    counts = {"wordly": 5, "worldly": 30, "worldlyx": 160, "worldlyy": 160, "étésété": 5, "étését": 25, "short": 50, "rareword": 4}
    docs = [(i, f"{w.upper() if w.isascii() else w} 12 {w}", "x", i) for i, (w, k) in enumerate(counts.items()) for _ in range(k // 2)]
    docs += [(1, None, None, 0), (2, "", None, 0), (None, "nullid " * 7, None, 0), (3, "longtext " * 30_000, None, 0), (1, None, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n long")
    found = spelling.spelling_variants(df).collect()
    assert sorted(map(tuple, found)) == expected(words_of([d[:2] for d in docs]))
    of = {r["word"]: r for r in found}
    assert of["worldly"]["form"] == "worldlyx" and of["worldly"]["n_near"] == 2


def test_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).count() == 0
