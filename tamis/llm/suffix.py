"""Repeated substrings across a corpus, by anchors and deep-shallow suffix sorting.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier. Sorting all suffixes of a corpus is not needed for that:

1. Each window of ``length`` bytes selects an anchor, the 32-byte gram of least
   hash in it. Equal windows select equal anchors, so they meet by the anchor's
   hash; the windows that one anchor serves make its context.
2. Occurrences of an anchor in an equal context are repeats of the earliest.
   Only anchors with several different contexts (where copies begin, end or
   differ) go on, with one occurrence per context.
3. The windows of these contexts are suffixes, cut at ``length``, that are sorted:
   multikey quicksort by words of eight bytes down to a shallow depth, then
   blind tries for the groups that still share their prefix. Windows that end in
   one leaf are equal; all but the earliest are repeats.

Contexts are compared by 112 bits of hash in step 2, windows by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import chunks, per_batch

GRAM = 32
CHUNK = 1 << 21  # bytes hashed at once
WIDE = 1 << 14  # contexts of one anchor that are sorted in one task
SHALLOW = 2  # words of eight bytes
_NO_ID = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice (or less) the bytes, from those at distance ``step``."""
    out = h[:-step] * _A
    out += h[step:] * _B
    out ^= out >> np.uint64(32)
    return out


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * _B) ^ (a >> np.uint64(29))
    out = (out + b) * _A
    return out ^ (out >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the segments of ``data`` that end at ``ends``: anchor hash, context
    hash, first window and number of windows of each anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    for step in (1, 2, 4, 8, 16):
        h = _mixed(h, step)
    gram, h64 = h, _mixed(h, 32)
    # least gram of each window; of equal ones the last
    width = length - GRAM + 1
    low = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram) - 1, -1, -1, dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[width - step : width - step + n])
    place = len(gram) - 1 - (low & np.uint64(0xFFFFFF)).astype(np.int64)
    segment = np.searchsorted(ends, np.arange(n), side="right")
    fits = np.arange(n) + length <= ends[segment]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new & fits)
    # within a segment the windows that fit come first, so a run ends at the next or where fitting stops
    run = np.cumsum(new & fits)[fits] - 1
    count = np.bincount(run, minlength=len(first))
    last = first + count - 1
    at = place[first]
    # parts of 64 bytes that cover a window
    parts = [*range(0, length - 64, 64), length - 64]
    whole = lambda j: reduce(_both, [h64[j + p] for p in parts])
    context = _both(_both(whole(first), whole(last)), ((at - first) * max(256, length) + count).astype(np.uint64))
    return gram[at] >> np.uint64(16), context, first, count


_ANCHORS = "anchor bigint, context bigint, id bigint, rid bigint, start bigint, n int"


def _known_repeats(columns: list[np.ndarray]) -> None:
    """Marks, by a negative number of windows, the rows of a batch whose context
    an earlier row of the batch has. They are settled and need not meet the
    others of their anchor, so copies do not gather: their anchor becomes a
    random one."""
    anchor, context, ids, rids, start, n = columns
    mixed = (anchor ^ (context * np.int64(0x2545F4914F6CDD1D))).view(np.uint64)
    order = np.argsort(mixed)
    equal = mixed[order][1:] == mixed[order][:-1]
    often = np.zeros(len(order), bool)
    often[1:] |= equal
    often[:-1] |= equal
    at = order[often]
    at = at[np.lexsort((start[at], rids[at], ids[at], context[at], anchor[at]))]
    a, b = at[:-1], at[1:]
    same = (anchor[a] == anchor[b]) & (context[a] == context[b])
    same &= (ids[a] != ids[b]) | (rids[a] != rids[b]) | (start[a] != start[b])
    known = b[same]
    n[known] *= -1
    anchor[known] = (_both(ids[known].view(np.uint64), start[known].view(np.uint64)) >> np.uint64(16)).astype(np.int64)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """A row for each anchor of each document."""

    names = [x.split()[0] for x in _ANCHORS.split(", ")]
    types = [pa.int64()] * 5 + [pa.int32()]

    def rows_of(pieces: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
        ends = np.cumsum([len(x[3]) for x in pieces])
        data = np.frombuffer(b"".join(x[3] for x in pieces), np.uint8)
        anchor, context, first, count = anchors(data, ends, length)
        segment = np.searchsorted(ends, first, side="right")
        ids, rids, base = (np.array([x[k] for x in pieces], np.int64)[segment] for k in range(3))
        begin = np.concatenate([[0], ends[:-1]])[segment]
        return [anchor.astype(np.int64), context.view(np.int64), ids, rids, first - begin + base, count.astype(np.int32)]

    def made(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out)]
        _known_repeats(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 * CHUNK):
                out, pieces, size = [], [], 0
                for i, rid, text in zip(part["id"].to_pylist(), part["rid"].to_pylist(), part["text"]):
                    raw = (text.as_py() or "").encode()
                    for at in range(0, len(raw) - length + 1, CHUNK):  # windows that start in this piece
                        pieces.append((i, rid, at, raw[at : at + CHUNK + length - 1]))
                        size += len(pieces[-1][3])
                        if size >= CHUNK:
                            out.append(rows_of(pieces))
                            pieces, size = [], 0
                if pieces:
                    out.append(rows_of(pieces))
                if out:
                    yield made(out)

    return docs.mapInArrow(run, _ANCHORS)


def _repeats(found: DataFrame, length: int) -> DataFrame:
    """Of anchors sorted by hash, context and place: rows without an anchor are
    repeats of an equal context; rows with one are the first of a context whose
    anchor has others."""
    names = ["anchor", "context", "id", "rid", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: np.ndarray | None = None  # the last row seen
        held: tuple[np.ndarray, bool] | None = None  # the last first-of-context, and whether its anchor had one before

        def rows(table: np.ndarray, first: bool) -> pa.RecordBatch:
            anchor = pa.array(table[:, 0] if first else [None] * len(table), pa.int64())
            numbers = [pa.array(table[:, k]) for k in (2, 3, 4)]
            n = pa.array(np.abs(table[:, 5]))
            return pa.RecordBatch.from_arrays([anchor, *numbers, n], ["anchor", "id", "rid", "start", "n"])

        for batch in batches:
            table = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            known = table[:, 5] < 0
            if known.any():
                yield rows(table[known], first=False)
                table = table[~known]
            if not len(table):
                continue
            lead = table if before is None else np.vstack([before, table])
            same = np.zeros(len(lead), bool)
            same[1:] = (lead[1:, :2] == lead[:-1, :2]).all(axis=1)
            itself = np.zeros(len(lead), bool)
            itself[1:] = (lead[1:] == lead[:-1]).all(axis=1)  # a repeated row of the same document
            skip = 0 if before is None else 1
            yield rows(lead[skip:][(same & ~itself)[skip:]], first=False)
            firsts = lead[skip:][~same[skip:]]
            if held is not None:
                firsts = np.vstack([held[0][None], firsts])
            if len(firsts):
                earlier = np.zeros(len(firsts), bool)
                earlier[1:] = firsts[1:, 0] == firsts[:-1, 0]
                earlier[0] = held is not None and held[1]
                shared = earlier.copy()
                shared[:-1] |= earlier[1:]
                yield rows(firsts[:-1][shared[:-1]], first=True)
                held = firsts[-1].copy(), bool(earlier[-1])
            before = table[-1:].copy()
        if held is not None and held[1]:
            yield rows(held[0][None], first=True)

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "context", "id", "rid", "start")
    return ordered.mapInArrow(run, "anchor bigint, id bigint, rid bigint, start bigint, n bigint")


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts``, cut at ``length`` bytes, within
    their groups, and the class of each place in it: equal suffixes of a group
    share a class. ``data`` has at least ``length`` bytes behind every start."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    offsets = [*range(0, length - 8, 8), length - 8]

    def divided(order: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by keys, the first one leading, and where they change."""
        order_of = np.lexsort(keys[::-1])
        change = np.ones(len(order), bool)
        change[1:] = np.any([k[order_of][1:] != k[order_of][:-1] for k in keys], axis=0)
        return order[order_of], np.cumsum(change) - 1

    order, cls = divided(np.arange(len(starts)), [group, words[starts]])
    open_ = np.ones(len(order), bool)

    def unresolved() -> np.ndarray:
        size = np.bincount(cls)
        return np.flatnonzero(open_ & (size[cls] > 1))

    def refine(at: np.ndarray, keys: list[np.ndarray]) -> None:
        """Sort the places ``at`` (whole classes) by keys within their classes."""
        nonlocal cls
        order[at], sub = divided(order[at], [cls[at], *keys])
        new = np.ones(len(order), bool)
        new[1:] = cls[1:] != cls[:-1]
        new[at[1:]] |= sub[1:] != sub[:-1]
        cls = np.cumsum(new) - 1

    for offset in offsets[1:SHALLOW]:
        at = unresolved()
        if len(at):
            refine(at, [words[starts[order[at]] + offset]])
    # Blind tries, all groups at once: the first suffix of a group is followed to where each other
    # leaves it; only that place and the byte there are kept, which divide the group.
    while len(at := unresolved()):
        own = starts[order[at]]
        lead = np.ones(len(at), bool)
        lead[1:] = cls[at][1:] != cls[at][:-1]
        pivot = own[np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))]
        leaves = np.full(len(at), length)
        byte, pivot_byte = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        for offset in offsets:
            differ = words[own[left] + offset] ^ words[pivot[left] + offset]
            there = np.flatnonzero(differ)
            if len(there):
                k = (differ[there].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
                rows = left[there]
                leaves[rows] = offset + k
                byte[rows], pivot_byte[rows] = data[own[rows] + offset + k], data[pivot[rows] + offset + k]
                left = left[differ == 0]
        side = np.sign(byte - pivot_byte)
        leaf = leaves == length
        open_of = np.ones(len(order), bool)
        open_of[order[at[leaf]]] = False  # by suffix, as places change
        closed = np.ones(len(order), bool)
        closed[order] = ~open_
        refine(at, [side, -side * leaves, byte])
        open_ = ~closed[order] & open_of[order]
    return order, cls


_COVERED = "id bigint, rid bigint, start bigint, stop bigint, window binary"


def _sorted_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among the windows of different contexts: rows without a window.
    The windows of an anchor with more than WIDE contexts come as rows of their
    own instead, to be compared by another shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 4 + [pa.binary()]
            names = [x.split()[0] for x in _COVERED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names)

        def compared(rows: list[tuple]) -> pa.RecordBatch:
            """Rows of whole groups (anchor, id, rid, start, bytes), earlier places first."""
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            sizes = np.array([len(r[4]) for r in rows])
            count = sizes - length + 1
            row = np.repeat(np.arange(len(rows)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = (np.cumsum(sizes) - sizes)[row] + within
            order, cls = sort_suffixes(data, starts, np.array([r[0] for r in rows], np.int64)[row], length)
            least = np.full(cls[-1] + 1, len(starts))
            np.minimum.at(least, cls, order)
            repeat = np.ones(len(starts), bool)
            repeat[least] = False
            begin = repeat.copy()
            begin[1:] &= ~repeat[:-1] | (row[1:] != row[:-1])
            end = repeat.copy()
            end[:-1] &= ~repeat[1:] | (row[1:] != row[:-1])
            out = []
            for r, a, b in zip(row[begin].tolist(), within[begin].tolist(), within[end].tolist()):
                _, i, rid, start, _ = rows[r]
                out.append((i, rid, start + a, start + b + length, None))
            return made(out)

        def windows(r: tuple) -> Iterator[tuple]:
            _, i, rid, start, raw = r
            for k in range(len(raw) - length + 1):
                yield i, rid, start + k, start + k + length, raw[k : k + length]

        kept: list[tuple] = []  # of whole groups, and of the one that goes on
        group, wide, last = 0, False, None
        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("anchor", "id", "rid", "start", "bytes"))):
                if last is not None and r[:4] == last[:4]:
                    continue  # a repeated row of the same document
                if last is None or r[0] != last[0]:
                    if len(kept) >= 4096:
                        yield compared(kept)
                        kept = []
                    group, wide = len(kept), False
                last = r
                if not wide and len(kept) - group >= WIDE:
                    wide = True
                    for i in range(group, len(kept), 256):
                        yield made([w for x in kept[i : i + 256] for w in windows(x)])
                    kept = kept[:group]
                if wide:
                    yield made(list(windows(r)))
                else:
                    kept.append(r)
        if kept:
            yield compared(kept)

    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor", "id", "rid", "start")
    return ordered.mapInArrow(run, _COVERED)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts that are asked for."""
    lists = wanted.groupBy("id", "rid").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("asked"))

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for i, rid, text, asked in zip(*(batch[c].to_pylist() for c in ("id", "rid", "text", "asked"))):
                raw = text.encode()
                for x in asked:
                    row = (x["anchor"], i, rid, x["start"], raw[x["start"] : x["start"] + x["n"] + length - 1])
                    for column, cell in zip(out, row):
                        column.append(cell)
            types = [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["anchor", "id", "rid", "start", "bytes"]
            )

        return convert

    joined = docs.join(lists, ["id", "rid"])
    return per_batch(joined, "anchor bigint, id bigint, rid bigint, start bigint, bytes binary", make)


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, rid, start, stop): byte ranges of windows that also start earlier.
    ``docs`` has id, rid and text. Ranges may overlap and touch."""
    found = _repeats(_anchors(docs, length), length)
    whole = found.where("anchor is null").select("id", "rid", "start", (F.col("start") + F.col("n") + length - 1).alias("stop"))
    covered = _sorted_contexts(_contexts(docs, found.where("anchor is not null"), length), length)
    # windows of wide anchors repeat the earliest of their bytes; other rows stay, each in a place of its own
    salt = F.when(F.col("window").isNull(), F.xxhash64("id", "rid", "start"))
    order = Window.partitionBy("window", salt).orderBy("id", "rid", "start")
    rest = covered.withColumn("nth", F.row_number().over(order)).where("window is null or nth > 1")
    return whole.unionByName(rest.select("id", "rid", "start", "stop"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), spans (their starts and stops), kept (the remaining bytes).

    Every byte goes that a string of ``length`` bytes (64 at least) covers which
    also starts earlier: in a smaller doc_id or earlier in the same. Null texts
    count as empty. A null doc_id is smaller than all; rows of equal doc_id are
    ordered by a checksum of their text, and a fully repeated row is the same
    document again, so both get the same result. An empty table gives no rows;
    other columns are not read."""
    if length < 64:
        raise ValueError("windows are hashed in parts of 64 bytes")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("rid"),
        "text",
    )
    spans = repeated_spans(keyed, length).groupBy("id", "rid").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    joined = keyed.join(spans, ["id", "rid"], "left").select("id", "text", "found")

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6)]
            for part in chunks(batch, "text"):
                for i, text, found in zip(*(part[c].to_pylist() for c in ("id", "text", "found"))):
                    raw = (text or "").encode()
                    merged: list[list[int]] = []
                    for a, b in sorted((x["start"], x["stop"]) for x in found or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(e for m in merged for e in m), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    values = (None if i == _NO_ID else i, len(raw), len(raw) - len(kept), len(merged), merged, kept)
                    for column, cell in zip(out, values):
                        column.append(cell)
            big = pa.int64()
            types = [big, big, big, big, pa.list_(pa.list_(big)), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        return convert

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept binary"
    return per_batch(joined, schema, make)
