"""Spelling variants: words that one edit apart, found by scans of sorted lists.

The vocabulary is kept as two sorted lists, of the words and of the reversed
words, each cut into chunks. A word is compared with a list entry by rows of the
edit matrix, one row per letter of the entry and only the three cells around the
diagonal. Neighbours in a sorted list share a prefix, so the rows of that prefix
are used again, and where all cells of a row exceed one edit, the scan goes on
behind all entries with that prefix.

Words that are one edit apart agree before or behind the edit for half their
length. So each scan starts with an agreeing half: the forward list gives the
neighbours that first differ behind the middle, the reversed list the others.
Which chunks a word has to visit is told by the same scan over what the entries of
each chunk have in common.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import ascii_lower, partitions, written

RUNS = "[A-Za-zÀ-ÿ]+"
CHUNK, MAX_CHUNKS, COMMON = 4096, 1 << 16, 64
_END = "\U0010ffff"  # behind every letter
_ROWS = 1 << 15  # of output at once


def dropped_letter(doc_id: Column, run: Column, every: int) -> Column:
    """The run; of one in ``every`` pairs of document and run, without one letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the frequent words of ``docs``. Counts combine before the shuffle."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_letters).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select(dropped_letter(F.col("doc_id"), F.col("run"), every).alias("word"))
    counts = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def half(word: str, reverse: bool) -> int:
    """How many leading letters of the word (as it is in its list) a neighbour
    to be found in that list shares."""
    before = (len(word) - 1) // 2
    return len(word) - before if reverse else before


def _next_row(row: tuple[int, int, int], depth: int, letter: str, word: str) -> tuple[int, int, int]:
    """The row of an entry's letter number ``depth`` (from 0): cells of the
    word's prefixes of depth, depth + 1 and depth + 2 letters; 2 stands for more."""
    n = len(word)
    a, b, c = row
    left = a + (depth < 1 or depth > n or word[depth - 1] != letter)
    if b + 1 < left:
        left = b + 1
    middle = b + (depth >= n or word[depth] != letter)
    if c + 1 < middle:
        middle = c + 1
    if left + 1 < middle:
        middle = left + 1
    right = c + (depth + 1 >= n or word[depth + 1] != letter)
    if middle + 1 < right:
        right = middle + 1
    return left if left < 2 else 2, middle if middle < 2 else 2, right if right < 2 else 2


def scan(word: str, entries: Sequence[str], shared: Sequence[int], start: int, low: int, high: int, whole: bool) -> list[int]:
    """Positions in entries[low:high], which all start with the first ``start``
    letters of ``word`` (or end before), of those at a distance of exactly one.
    ``shared[i]`` is how many letters entry i has in common with the one before.
    If not ``whole``, entries are beginnings: those from which a distance of at
    most one can still be reached."""
    found, n = [], len(word)
    rows = {start: (1, 0, 1)}  # by depth: the rows of the entry looked at last
    known, at = start, low
    while at < high:
        entry = entries[at]
        depth = min(known, shared[at]) if at > low else start
        row = rows[depth if depth > start else start]
        depth = max(depth, start)
        size = len(entry)
        while depth < size:
            row = _next_row(row, depth, entry[depth], word)
            depth += 1
            rows[depth] = row
            if row == (2, 2, 2):
                break
        known = depth
        if row == (2, 2, 2):
            # all entries with these letters are as far
            if whole:
                at = bisect_left(entries, entry[:depth] + _END, at + 1, high)
            else:  # beginnings are not sorted
                at += 1
                while at < high and shared[at] >= depth:
                    at += 1
            continue
        if not whole or (-1 <= n - size <= 1 and row[n - size + 1] == 1):
            found.append(at)
        at += 1
    return found


def common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_with_last(entries: Sequence[str]) -> list[int]:
    return [0, *map(common, entries, entries[1:])][: len(entries)]


class Chunks:
    """The chunks of both lists, on each worker: first and last entry, cut to
    COMMON letters, so at most MAX_CHUNKS short texts a list."""

    def __init__(self, rows: list[tuple[bool, int, str, str]]):
        self.lists = {}
        for reverse in (False, True):
            own = sorted((r for r in rows if r[0] == reverse), key=lambda r: (r[2], r[3], r[1]))
            both = [first[: common(first, last)] for _, _, first, last in own]
            self.lists[reverse] = ([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], both)

    def reached(self, word: str, reverse: bool) -> list[int]:
        """Of all chunks that may hold a neighbour found in this list."""
        ids, firsts, lasts, both = self.lists[reverse]
        head = word[: min(half(word, reverse), COMMON)]
        low, high = bisect_left(lasts, head), bisect_left(firsts, head + _END)
        if high - low < 2:
            return ids[low:high]
        # chunks between the outer two hold only entries with this head
        inner = both[low + 1 : high - 1]
        kept = scan(word, inner, shared_with_last(inner), len(head), 0, len(inner), whole=False)
        return [ids[low], *(ids[low + 1 + i] for i in kept), ids[high - 1]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk, first its entries in order, then the words that visit it."""
    here, entries, counts, shared = None, [], [], None
    out: tuple[list, list, list] = ([], [], [])

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())]
        for column in out:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, ["word", "near", "near_n"])

    for batch in batches:
        for chunk, visits, reverse, key, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "visits", "reverse", "key", "n"))):
            if here != chunk:
                here, entries, counts, shared = chunk, [], [], None
            if not visits:
                entries.append(key)
                counts.append(n)
                continue
            if shared is None:
                shared = shared_with_last(entries)
            start = half(key, reverse)
            head = key[:start]
            low, high = bisect_left(entries, head), bisect_left(entries, head + _END)
            before = len(key) - start
            for i in scan(key, entries, shared, start, low, high, whole=True):
                near = entries[i][::-1] if reverse else entries[i]
                word = key[::-1] if reverse else key
                if reverse and common(word, near) >= before:
                    continue  # the forward list gives it
                out[0].append(word)
                out[1].append(near)
                out[2].append(counts[i])
            if len(out[0]) >= _ROWS:
                yield flush()
    if out[0]:
        yield flush()


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n; distinct) that
    are one inserted, deleted or replaced letter apart, in both directions."""
    size = words.count()
    # chunks grow only once there are more than MAX_CHUNKS of them
    many = min(max(2 * size // chunk, 1), 2 * MAX_CHUNKS)
    listed = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse"), "word", "n")
    listed = listed.select("reverse", F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")).alias("key"), "n")
    ranges = listed.repartitionByRange(many, "reverse", "key")
    # a range with the end of one list and the start of the other is two chunks
    entries = written(ranges.withColumn("chunk", 2 * F.spark_partition_id() + F.col("reverse").cast("int")), "entries")
    ends = entries.groupBy("chunk", "reverse").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    cut = ends.select("reverse", "chunk", F.substring("first", 1, COMMON), F.substring("last", 1, COMMON))
    chunks = Chunks([tuple(r) for r in cut.collect()])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visits = [
                (reverse, key, to)
                for reverse, key in zip(batch["reverse"].to_pylist(), batch["key"].to_pylist())
                for to in chunks.reached(key, reverse)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*visits), (pa.bool_(), pa.string(), pa.int32()))] if visits else
                [pa.array([], t) for t in (pa.bool_(), pa.string(), pa.int32())],
                ["reverse", "key", "chunk"],
            )

    visits = entries.select("reverse", "key").mapInArrow(visit, "reverse boolean, key string, chunk int")
    both = entries.select("chunk", F.lit(False).alias("visits"), "reverse", "key", "n").unionByName(
        visits.select("chunk", F.lit(True).alias("visits"), "reverse", "key", F.lit(None).cast("bigint").alias("n"))
    )
    ordered = both.repartition("chunk").sortWithinPartitions("chunk", "visits", "key")
    return ordered.mapInArrow(_meet, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form. A form is several times as frequent
    as its word, so the way to the last one is short; each round doubles the
    steps taken."""
    ways = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        above = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(above, "root", "left")
        ways = written(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        moved = ways.where("moved").limit(1).count()
        ways = ways.drop("moved")
        if not moved:
            return ways


def spelling_variants(docs: DataFrame, ratio: int = 5, chunk: int = CHUNK, **counted: int) -> DataFrame:
    """One row per frequent word of ``docs`` (doc_id, text): word, form, root,
    n, n_near and form_n.

    The form is the most frequent near word, of ties the first in code-point
    order, if it is at least ``ratio`` times as frequent; the root is where forms
    lead to. Words are as ``vocabulary`` counts them: null and empty texts have
    none, repeated rows count each, a null doc_id is an empty one. An empty table
    gives no rows; other columns are not read."""
    words = written(vocabulary(docs, **counted), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words, chunk).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    of = words.join(near, "word", "left")
    common_enough = -F.col("best.minus") >= ratio * F.col("n")
    of = written(
        of.select(
            "word",
            F.when(common_enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(common_enough, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(of.where("form is not null"))
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
