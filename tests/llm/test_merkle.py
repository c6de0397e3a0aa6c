"""The manifest against a plain tree, and hash states against hashlib."""

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import merkle, sha_state
from tamis.llm.queries import op12_merkle, tampered
from tamis.llm.tables import table


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of ``nodes``, and of each the runs on its way with its slots."""
    ways = [[] for _ in nodes]
    level, own = nodes, list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for way, at in zip(ways, own):
            way.append((runs[at // 8], at % 8))
        own = [at // 8 for at in own]
        level = [H(*r) for r in runs]
    return level[0], ways


def expected(docs):
    """docs: dicts with FIELDS. One tuple per row."""
    rows = []
    for d in docs:
        values = [d[c] for c in merkle.FIELDS]
        own = leaf(*values)
        bad = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
        low = "".join(c.lower() if c.isascii() else c for c in d["text"]) if bad else None
        rows.append((d["lang"], d["doc_id"], own, leaf(*values[:-1], low) if bad else own))
    rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[0])]
    climbed = [climb([r[2] for r in g]) for g in groups]
    root, above = climb([c[0] for c in climbed]) if climbed else (None, [])
    out = []
    for g, (subroot, ways), high in zip(groups, climbed, above):
        for (_, doc_id, own, changed), way in zip(g, ways):
            folded, siblings = changed, []
            for run, slot in way + high:
                siblings += run[:slot] + run[slot + 1 :]
                folded = H(*run[:slot], folded, *run[slot + 1 :])
            out.append((doc_id, own, subroot, root, H(*siblings), folded, folded == root))
    return out


def compare(found, docs):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, found), key=key) == sorted(expected(docs), key=key)


def test_states_resume():
    random = np.random.default_rng(1)
    digests = [random.bytes(32) for _ in range(50)]
    state = np.tile(sha_state.START, (1, 1))
    for i, d in enumerate(digests):
        state = sha_state.absorb(state, sha_state.hex_block(sha_state.to_words([d])))
        done = sha_state.to_bytes(sha_state.finish(state, np.array([i + 1])))[0]
        assert done.hex() == H(*(x.hex() for x in digests[: i + 1]))
    none = sha_state.finish(np.tile(sha_state.START, (1, 1)), np.array([0]))
    assert sha_state.to_bytes(none)[0].hex() == H()


def test_documents_of_the_table(spark, data, rows):
    found = op12_merkle(spark, data).collect()
    compare(found, rows("documents"))
    assert any(not r["verified"] for r in found) and any(r["verified"] for r in found)


@pytest.mark.parametrize("run_size", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, run_size):
    docs = [{"doc_id": i, "source": None, "lang": "x", "n_chars": i, "text": f"T{i}"} for i in range(run_size)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, source string, lang string, n_chars long, text string")
    compare(merkle.manifest(df, tampered()).collect(), docs)


def test_trees_above_a_block(spark):
    """Blocks of 64 leaves, so that paths have several steps; many languages."""
    sizes = {None: 5, "": 1, "a": 64, "b": 65, "hot": 4200, **{f"l{i}": 1 + i % 3 for i in range(80)}}
    docs = [
        {"doc_id": 7 * i, "source": "s", "lang": lang, "n_chars": None, "text": f"Text {i}"}
        for lang, n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, source string, lang string, n_chars long, text string")
    compare(merkle.manifest(df, tampered(), folds=2).collect(), docs)


def test_odd_rows(spark, odd_docs):
    compare(merkle.manifest(odd_docs, tampered()).collect(), [r.asDict() for r in odd_docs.collect()])


def test_no_rows(spark, data):
    none = table(spark, data, "documents").limit(0)
    assert merkle.manifest(none, tampered()).count() == 0


def test_any_change_is_found(spark, data):
    docs = table(spark, data, "documents")
    found = merkle.manifest(docs, F.lit(True), F.concat("text", F.lit("!"))).collect()
    assert not any(r["verified"] for r in found)
