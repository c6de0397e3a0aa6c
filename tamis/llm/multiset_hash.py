"""Document fingerprints that are sums over paragraphs.

Every paragraph (a line) is hashed to a wide vector, and a text's fingerprint is
the sum of its paragraphs' vectors, each component modulo 2 ** 32. So the order
of paragraphs does not matter, inserting one is an addition and deleting one a
subtraction. A vector has two parts:

* ``EXACT`` words of the paragraph's 512-bit hash. Their sums are equal if the
  multisets of paragraphs are, and else only by accident.
* ``SKETCH`` sums of signs of the paragraph's three-word shingles. The inner
  product of two such sums estimates that of the shingle counts, so their cosine
  estimates how much of two texts is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import partitions

EXACT, SKETCH, WORDS = 16, 128, 3
WIDTH = EXACT + SKETCH
_BYTES = 8 << 20  # of text hashed at once
_ROWS = 1 << 15  # shingles spread to signs at once
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _sign_sums(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of SKETCH sums for each run of shingles that ends at ``ends``."""
    out = np.zeros((len(ends), SKETCH), np.int64)
    for at in range(0, len(shingles), _ROWS):
        part = shingles[at : at + _ROWS]
        lanes = np.stack([_mixed(part + np.uint64(i + 1)) for i in range(SKETCH // 64)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1)
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        starts = np.concatenate([[0], ends[first:last] - at])
        size = np.diff(np.concatenate([starts, [len(part)]]))
        many = size > 0  # runs without shingles stay zero
        sums = np.add.reduceat(bits, starts[many], axis=0, dtype=np.int64)
        out[first : last + 1][many] += 2 * sums - size[many][:, None]
    return out


def vectors(texts: Sequence[str | None]) -> np.ndarray:
    """One row of WIDTH uint32 per text; ``None`` holds no paragraph and gives
    zeros, the empty text holds one empty paragraph. A paragraph of fewer than
    three words is one shingle, one without words none."""
    import xxhash

    exact = np.zeros((len(texts), EXACT), np.uint32)
    hashes: list[int] = []
    line_ends, text_ends = [], []
    for i, text in enumerate(texts):
        if text is not None:
            lines = text.encode().split(b"\n")
            digest = b"".join(hashlib.blake2b(line).digest() for line in lines)
            exact[i] = np.frombuffer(digest, "<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
            for line in lines:
                hashes += map(xxhash.xxh64_intdigest, line.split())
                line_ends.append(len(hashes))
        text_ends.append(len(line_ends))
    words = np.array(hashes, np.uint64)
    stop = np.array(line_ends, np.int64)
    size = np.diff(stop, prepend=0)
    # a shingle begins at every word with two more in its line, and at the first of a short line
    begins = np.ones(len(words), bool)
    for back in range(1, WORDS):
        at = stop - back
        begins[at[(size >= back) & ((size >= WORDS) | (back < size))]] = False
    start = np.flatnonzero(begins)
    line = np.searchsorted(stop, start, side="right")
    h = np.minimum(size[line], WORDS).astype(np.uint64)
    for j in range(WORDS):
        inside = start + j < stop[line]
        h[inside] = _mixed(h[inside] + words[start[inside] + j])
    per_line = np.concatenate([[0], np.cumsum(np.where(size > 0, np.maximum(size - WORDS + 1, 1), 0))])
    sketch = _sign_sums(h, per_line[np.array(text_ends, np.int64)])
    return np.concatenate([exact, sketch.astype(np.uint32)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else the cosine of the sign sums,
    0 where it is negative or one side has no words."""
    same = (a == b).all(axis=1)
    x, y = (v[:, EXACT:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = (x * y).sum(axis=1) / np.where(norm > 0, norm, 1)
    return np.where(same, 1.0, np.clip(cosine, 0, 1))


def hex_of(v: np.ndarray) -> list[str]:
    return [row.astype("<u4").tobytes().hex() for row in v]


def of_hex(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(texts)), "<u4").reshape(-1, WIDTH)


def inserted(fingerprint: str, paragraphs: Sequence[str]) -> str:
    """The fingerprint after further paragraphs, in any place."""
    return hex_of(of_hex([fingerprint]) + vectors(paragraphs).sum(axis=0, dtype=np.uint32))[0]


def deleted(fingerprint: str, paragraphs: Sequence[str]) -> str:
    """The fingerprint without the given paragraphs."""
    return hex_of(of_hex([fingerprint]) - vectors(paragraphs).sum(axis=0, dtype=np.uint32))[0]


class _Row:
    """A document between reading and output."""

    __slots__ = ("doc_id", "text", "kept", "removed", "added", "edited", "own")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.own, self.edited = doc_id, text, None, None
        cut = len(text) - len(text) // 2
        line = text.rfind("\n", 0, cut) + 1  # the start of the line that the cut falls into
        self.kept, self.removed = text[: line - 1] if line else None, text[line:]

    def followed_by(self, other: str) -> None:
        n = len(self.text)
        self.edited = self.text[: n - n // 2] + other[: n // 2]
        self.added = self.edited[len(self.text) - len(self.removed) :]


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _digests(rows: list[tuple[_Row, _Row]]) -> pa.RecordBatch:
    """Output of documents with their successors. What a document keeps is
    hashed once; the rest of it and the rest of its edited text are inserted."""
    todo = {id(r): r for pair in rows for r in pair if r.own is None}
    parts = [x for r in todo.values() for x in (r.kept, r.removed)]
    found = vectors([*parts, *(a.added for a, _ in rows)])
    keeps = {}
    for i, (key, r) in enumerate(todo.items()):
        keeps[key] = found[2 * i]
        r.own = (found[2 * i] + found[2 * i + 1], found[2 * i])
    own = np.array([a.own[0] for a, _ in rows])
    edited = np.array([a.own[1] for a, _ in rows]) + found[len(parts) :]
    following = np.array([b.own[0] for _, b in rows])
    columns = [
        pa.array([a.doc_id for a, _ in rows], pa.int64()),
        pa.array([len(a.text) for a, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(a.edited.encode()).hexdigest() for a, _ in rows]),
        pa.array(hex_of(own)),
        pa.array(hex_of(edited)),
        pa.array(likeness(own, edited)),
        pa.array(likeness(own, following)),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts, each in order and followed by the first of the next."""
    last, part = None, None
    ready: list[tuple[_Row, _Row]] = []
    size = 0
    for batch in batches:
        for at, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))):
            if ahead and last is None:  # one more row like the first of the next part
                continue
            row = _Row(doc_id, text or "")
            if last is not None and part == at:
                last.followed_by(row.text)
                ready.append((last, row))
                size += 3 * len(row.text) + len(last.text)
            last, part = None if ahead else row, at
            if size >= _BYTES:
                yield _digests(ready)
                ready, size = [], 0
    if ready:
        yield _digests(ready)


def _key() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))


def _part_of(bounds: list, key: Column) -> tuple[Column, Column]:
    """The number of the part whose first key is the last one not above ``key``,
    by binary search, and whether ``key`` is that first key."""
    known = F.array(*(F.struct(F.lit(b["known"]).alias("known"), F.lit(b["id"]).alias("id"), F.lit(b["h"]).alias("h")) for b in bounds))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = lambda i: F.element_at(known, i + 1)
    further = lambda lo, s: F.when((lo + s < len(bounds)) & (F.try_element_at(known, lo + s + 1) <= key), lo + s).otherwise(lo)
    part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
    return part, at(F.col("part")) == key


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_chars, fingerprint (hex),
    the sha256 and fingerprint of the edited text (its last half replaced by the
    start of the next document's text), and the likeness of the fingerprint to
    the edited text's and to the next document's.

    Documents follow each other by doc_id, null first; rows of one id by a hash
    of their text, then the text. The last is followed by the first, a single
    row by itself. Null text is empty. An empty table gives no rows; other
    columns are not read.

    Texts are shuffled once, by ranges of ids. The ranges are found on ids and
    hashes alone; each range ends with a copy of the first row of the next."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = narrow.select(_key().alias("key")).repartitionByRange(4 * partitions(spark), "key")
    firsts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).select("first")
    bounds = sorted({r["first"] for r in firsts.collect()}, key=tuple) or [{"known": False, "id": 0, "h": 0}]
    part, is_first = _part_of(bounds, F.col("key"))
    placed = narrow.withColumn("key", _key()).withColumn("part", part)
    here = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("ahead"))
    copies = placed.select("doc_id", "text", "key", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))).alias("at"))
    rows = copies.select("at.part", "at.ahead", "key", "doc_id", "text").repartition("part")
    ordered = rows.sortWithinPartitions("part", "ahead", "key", "text")
    return ordered.select("part", "ahead", "doc_id", "text").mapInArrow(_edited, _SCHEMA)
