"""SimHash near duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments. If two differ in at most
three bits, either one segment is equal and another differs in at most one bit,
or each of the three differs in exactly one. Segments that differ in at most one
bit share a key: the binary Golay code is perfect, every 23-bit word lies within
distance three of one codeword, and a word at distance three has five more
codewords at distance four, which are the only ones that can be nearest to its
neighbours. So a word has one index key (its nearest codeword) and one or six
probe keys, and an equi-join on pairs or triples of segments meets all near
fingerprints. Every meeting is verified by its bits inside the join.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.graph import components
from tamis.llm.tables import chunks, per_batch, written

MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
_GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1 divides x^23+1


class Golay:
    """Keys of 23-bit words: 12-bit indices of codewords."""

    def __init__(self):
        word = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = self._syndromes(word), self._syndromes(word << 11)
        self.nearest = np.full(2048, -1, np.int64)  # by syndrome: the error of at most three bits
        self.others = np.full((2048, 5), -1, np.int64)  # and the errors of four bits, if it has three
        for weight in range(4):
            errors = self._patterns(weight)
            self.nearest[self.syndrome(errors)] = errors
        errors = self._patterns(4)
        of = self.syndrome(errors)
        order = np.argsort(of, kind="stable")
        self.others[of[order], np.arange(len(order)) % 5] = errors[order]

    @staticmethod
    def _patterns(weight: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)

    @staticmethod
    def _syndromes(word: np.ndarray) -> np.ndarray:
        rest = word.copy()
        for bit in range(22, 10, -1):
            rest ^= ((rest >> bit) & 1) * (_GENERATOR << (bit - 11))
        return rest

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.low[word & 0x7FF] ^ self.high[word >> 11]

    def index(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self.nearest[self.syndrome(word)]) >> 11

    def probes(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and keys: all words that differ from ``word`` in at most
        one bit have their index among its keys."""
        of = self.syndrome(word)
        keys = np.concatenate([self.nearest[of][:, None], self.others[of]], axis=1)
        row, column = np.nonzero(keys >= 0)
        return row, (word[row] ^ keys[row, column]) >> 11


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (bigint) of every row. Words are runs of other
    than ASCII white space, A-Z lower-cased; a text with fewer than ``words`` is
    one shingle, null or empty text has the fingerprint zero."""

    def make():
        import xxhash

        hash_of = xxhash.xxh64_intdigest

        def fingerprint(text: str | None) -> int:
            tokens = (text or "").encode().lower().split()
            if not tokens:
                return 0
            joined = b" ".join(tokens)
            end = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
            last = end[words - 1 :].tolist() or [len(joined)]
            first = [0, *(end[: len(last) - 1] + 1).tolist()]
            h = np.fromiter((hash_of(joined[i:j], seed) for i, j in zip(first, last)), np.uint64, len(last))
            ones = np.zeros(64, np.int64)
            for i in range(0, len(h), 1 << 14):
                part = h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(x) for part in chunks(batch, "text") for x in part["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

        return convert

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return per_batch(narrow, "doc_id bigint, fingerprint bigint", make)


def _keys(distinct: DataFrame) -> DataFrame:
    """(key, probe, fingerprint) rows of distinct fingerprints: about ten index
    keys and 60 probe keys each."""

    def make():
        golay = Golay()

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = batch["fingerprint"].to_numpy(zero_copy_only=False).astype(np.int64)
            segment = [(prints >> at) & ((1 << width) - 1) for at, width in SEGMENTS]
            nearest = [golay.index(s) for s in segment]
            probes = [golay.probes(s) for s in segment]
            every = np.arange(len(prints))
            found: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for kind, (a, b) in enumerate(permutations(range(3), 2)):
                base = (segment[a] << 12) | (kind << 34)
                found.append((every, base | nearest[b], False))
                row, key = probes[b]
                found.append((row, base[row] | key, True))
            (row_a, key_a), (row_b, key_b), (row_c, key_c) = probes
            top = 6 << 36
            found.append((row_c, top | nearest[0][row_c] << 24 | nearest[1][row_c] << 12 | key_c, False))
            # each probe key of the first segment with each of the second
            start, many = np.searchsorted(row_b, every), np.bincount(row_b, minlength=len(prints))
            times = many[row_a]
            at = np.repeat(start[row_a] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            row = np.repeat(row_a, times)
            found.append((row, top | np.repeat(key_a, times) << 24 | key_b[at] << 12 | nearest[2][row], True))
            rows = np.concatenate([x[0] for x in found])
            probe = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[1] for x in found])), pa.array(probe), pa.array(prints[rows])],
                ["key", "probe", "fingerprint"],
            )

        return convert

    return per_batch(distinct, "key bigint, probe boolean, fingerprint bigint", make)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints that differ in at most
    ``max_bits`` (three at most) bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys meet fingerprints of at most {MAX_BITS} differing bits")
    keys = written(_keys(distinct), "keys")
    index = keys.where("not probe").select("key", F.col("fingerprint").alias("a"))
    probe = keys.where("probe").select("key", F.col("fingerprint").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return index.join(probe, (index["key"] == probe["key"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links reach.

    Rows of the same fingerprint are one node, so copies make no links. Empty
    and null texts share the fingerprint zero. A null doc_id is never the
    smallest; a component of nothing else has a null component_id. An empty
    table gives no rows; other columns are not read."""
    prints = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"))
    reached = components(links(nodes.select("fingerprint"), max_bits))
    of = nodes.join(reached, nodes["fingerprint"] == reached["node"], "left").select(
        "fingerprint", "first_doc", F.coalesce("component", "fingerprint").alias("component")
    )
    least = of.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of = of.join(least, "component").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
