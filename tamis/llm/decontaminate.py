"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of a benchmark item, or all
words of a shorter one. Patterns of one length are searched together. A table of
shifts, keyed by the block of words at the end of the search position, tells how
far no pattern can end; where it is zero, the bucket of patterns that end with
this block is compared word by word.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import chunks, per_batch, written

BLOCK = 2
MAX_TABLE_BYTES = 640 << 20
# What the tables take: for each word of an item (number, block, window, shift) and
# for each distinct word (an entry of the dictionary).
WORD_BYTES, NUMBER_BYTES = 56, 150
HASH_BITS, STRETCH = 36, 256
TEXT_BYTES = 1 << 20  # of texts cut into words at once; as objects, words take ten times that
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_STATE = "__hit array<bigint>, __items array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters and digits and all other than ASCII make words; A-Z count as a-z."""
    return (text or "").encode().lower().translate(_TO_WORDS).split()


class Items:
    """Benchmark items as numbers: all their words in one array, one number a
    distinct word. A window is a place in this array, never a copy of it."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words, self.sizes, self.ids = array("i"), array("q"), array("q")
        self.n_bytes = 0

    def add(self, item: int, text: str) -> None:
        words = words_of(text)
        if not words:
            return
        known = len(self.numbers)
        self.words.extend([self.numbers.setdefault(w, len(self.numbers)) for w in words])
        self.sizes.append(len(words))
        self.ids.append(item)
        self.n_bytes += WORD_BYTES * len(words) + sum(
            NUMBER_BYTES + len(w) for w in {w for w in words if self.numbers[w] >= known}
        )


class WuManber:
    """Search tables for the windows of one length, as sorted arrays.

    ``codes`` are the blocks of words in windows, ``shifts`` how far behind each
    the nearest end of a window lies. ``keys`` are the distinct windows, in
    buckets by the block they end with and by a hash within a bucket."""

    def __init__(self, words: np.ndarray, unknown: int, firsts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int):
        self.words, self.unknown, self.length, self.block = words, unknown, length, min(BLOCK, length)
        self.hash_bits, self.stretch = HASH_BITS, STRETCH
        self.free = length - self.block + 1  # the shift past a block that no window has
        self.weights = np.random.default_rng(length).integers(1, 1 << 63, length, np.uint64) | np.uint64(1)
        # the end of each block, counted from the start of its item
        ends = _ranges(sizes - self.block + 1) + self.block
        at = np.repeat(firsts, sizes - self.block + 1) + ends
        codes = self._codes(words, at)
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.shifts = np.minimum.reduceat(np.maximum(length - ends, 0)[order], first).astype(np.int64)
        # equal windows next to each other, with the items that hold them
        starts = np.repeat(firsts, sizes - length + 1) + _ranges(sizes - length + 1)
        items = np.repeat(ids, sizes - length + 1)
        keys = self._keys(words, starts + length, np.searchsorted(self.codes, self._codes(words, starts + length)))
        order = np.lexsort((items, keys))
        keys, starts, items = keys[order], starts[order], items[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        for j in range(length):  # windows that only share a hash stay apart
            new[1:] |= words[starts[1:] + j] != words[starts[:-1] + j]
        self.keys, self.starts = keys[new], starts[new]
        self.bounds, self.items = np.append(np.flatnonzero(new), len(keys)), items

    def _codes(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes = words[ends - 1].astype(np.int64)
        return codes if self.block == 1 else words[ends - 2].astype(np.int64) * (self.unknown + 1) + codes

    def _keys(self, words: np.ndarray, ends: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(ends), np.uint64)
        for j, weight in enumerate(self.weights):
            sums += (words[ends - self.length + j].astype(np.uint64) + np.uint64(1)) * weight
        return (bucket.astype(np.uint64) << np.uint64(self.hash_bits)) | (sums >> np.uint64(64 - self.hash_bits))

    def search(self, words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray):
        """(starts, windows) of the occurrences in texts that lie one after the
        other in ``words``. Stretches of texts are searched side by side, each by
        its own shifts."""
        n_ends = np.maximum(sizes - self.length + 1, 0)
        stretches = -(-n_ends // self.stretch)
        end = np.repeat(firsts + self.length, stretches) + self.stretch * _ranges(stretches)
        last = np.minimum(end + self.stretch - 1, np.repeat(firsts + sizes, stretches))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(end):
            codes = self._codes(words, end)
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            skip = np.where(self.codes[place] == codes, self.shifts[place], self.free)
            stop = skip == 0
            if stop.any():
                found += self._compare(words, end[stop], place[stop])
            end = end + np.maximum(skip, 1)
            on = end <= last
            end, last = end[on], last[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _compare(self, words: np.ndarray, ends: np.ndarray, bucket: np.ndarray):
        keys = self._keys(words, ends, bucket)
        place = np.searchsorted(self.keys, keys)
        while len(keys):
            same = place < len(self.keys)
            same[same] = self.keys[place[same]] == keys[same]
            ends, keys, place = ends[same], keys[same], place[same]
            equal = np.ones(len(ends), bool)
            for j in range(self.length):
                equal &= words[ends - self.length + j] == self.words[self.starts[place] + j]
            yield ends[equal] - self.length, place[equal]
            place = place + 1  # the next of the bucket with this hash


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    firsts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(firsts, sizes)


def searches(items: Items, window: int) -> list[WuManber]:
    words = np.frombuffer(items.words, np.int32) if items.words else np.empty(0, np.int32)
    sizes, ids = np.array(items.sizes, np.int64), np.array(items.ids, np.int64)
    firsts, lengths = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
    out = []
    for n in np.unique(lengths):
        own = lengths == n
        out.append(WuManber(words, len(items.numbers), firsts[own], sizes[own], ids[own], int(n)))
    return out


def _blocks(benchmark: DataFrame, limit: int):
    """Items whose tables take ``limit`` bytes, and one item more at most. Their
    number and size are those of the benchmark, not of the documents."""
    kept = Items()
    for item, text in benchmark.where("item_id is not null and text is not null").toLocalIterator():
        kept.add(item, text)
        if kept.n_bytes > limit:
            yield kept
            kept = Items()
    yield kept


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_table_bytes: int = MAX_TABLE_BYTES
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    No row moves between tasks: each task holds the tables of the benchmark
    texts, whose size is counted while they are read and bounded by
    ``max_table_bytes``. A larger benchmark is searched in several passes of that size, each written to the shared
    folder. Null texts and texts without words have none hit and the hash of the
    empty list; null items and items without words are never found; an empty
    benchmark hits nothing. Columns of ``docs`` with the result's names are replaced."""
    docs = docs.drop(*(x.split()[0] for x in _RESULT.split(", ")))
    state = docs.withColumns({"__hit": F.array().cast("array<bigint>"), "__items": F.array().cast("array<bigint>")})
    blocks = _blocks(benchmark.select(F.col("item_id").cast("bigint"), F.col("text")), max_table_bytes)
    block = next(blocks)
    for following in blocks:
        state = written(_pass(state, docs, block, window, last=False), "decontaminated")
        block = following
    return _pass(state, docs, block, window, last=True)


def _pass(state: DataFrame, docs: DataFrame, items: Items, window: int, last: bool) -> DataFrame:
    kept = docs.schema.simpleString()[len("struct<") : -1]
    tail = _RESULT if last else _STATE
    schema = f"struct<{kept},{','.join(':'.join(x.split(' ', 1)) for x in tail.split(', '))}>"
    shared = docs.sparkSession.sparkContext.broadcast((items.numbers, searches(items, window)))

    def make():
        numbers, tables = shared.value
        unknown = len(numbers)

        def occurrences(texts: list[list[bytes]]) -> tuple[list[list[int]], list[set[int]]]:
            """Hit places and found items of each text."""
            sizes = np.array([len(w) for w in texts], np.int64)
            firsts = np.cumsum(sizes) - sizes
            flat = (numbers.get(w, unknown) for words in texts for w in words)
            words = np.fromiter(flat, np.int32, int(sizes.sum()))
            hit, items = np.zeros(len(words), bool), [set() for _ in texts]
            for t in tables:
                starts, windows = t.search(words, firsts, sizes)
                for j in range(t.length):
                    hit[starts + j] = True
                # empty texts share a start with the text behind them, which is the last of these
                rows = np.searchsorted(firsts, starts, side="right") - 1
                for row, w in set(zip(rows.tolist(), windows.tolist())):
                    items[row].update(t.items[t.bounds[w] : t.bounds[w + 1]].tolist())
            places = np.flatnonzero(hit)
            cuts = np.searchsorted(places, np.append(firsts, len(words)))
            return [(places[a:b] - f).tolist() for a, b, f in zip(cuts[:-1], cuts[1:], firsts)], items

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in tail.split(", ")]
            old_hit, old_items = batch["__hit"], batch["__items"]
            row = 0
            for part in chunks(batch, "text", TEXT_BYTES):
                texts = [words_of(text) for text in part["text"].to_pylist()]
                for words, hit, found in zip(texts, *occurrences(texts)):
                    hit, found = {*hit, *old_hit[row].as_py()}, {*found, *old_items[row].as_py()}
                    row += 1
                    if last:
                        joined = ",".join(sorted(map(str, found)))
                        digest = hashlib.sha256(joined.encode()).hexdigest()
                        values = (len(words), len(hit), len(found), digest, bool(hit))
                    else:
                        values = (sorted(hit), sorted(found))
                    for column, v in zip(out, values):
                        column.append(v)
            big = pa.int64()
            types = [big, big, big, pa.string(), pa.bool_()] if last else [pa.list_(big)] * 2
            base = batch.drop_columns(["__hit", "__items"])
            names = [*base.schema.names, *(x.split()[0] for x in tail.split(", "))]
            return pa.RecordBatch.from_arrays([*base.columns, *(pa.array(v, t) for v, t in zip(out, types))], names)

        return convert

    return per_batch(state, schema, make)
