"""Best-fit packing of token sequences, planned over a histogram of lengths.

Only the histogram (at most ``size`` counts) meets on the driver. The plan says
for each length which ranks go to which sequences; it has at most two groups of
equal sequences per length, whatever the number of documents, since a length
uses up groups of open sequences whole, but for the last.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import chunks, partitions, per_batch, written
from tamis.llm.token_ids import encoder

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_SLOTS = ", sequence_id bigint, offset bigint"


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``size`` ids, one row each: doc_id, piece, start,
    length, ids_crc32 and, if asked for, the ids as binary.

    A document is the ids of its whole text and ``end_id``. Null text counts as
    empty, so every row gives at least one piece; a null doc_id stays null;
    repeated rows are documents of their own; other columns are not read. An
    empty table gives no rows."""
    schema = _PIECES + (", ids binary" if with_ids else "")
    columns = [x.split()[0] for x in schema.split(", ")]
    end = end_id.to_bytes(4, "little")

    def make():
        encode = encoder(tokenizer).encode

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in columns]
            for part in chunks(batch, "text"):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = memoryview(encode(text or "") + end)
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        row = (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), bytes(own) if with_ids else None)
                        for values, value in zip(out, row):
                            values.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], columns)

        return convert

    return per_batch(docs.select(F.col("doc_id").cast("bigint"), F.col("text")), schema, make)


@dataclass
class Plan:
    """Runs of ranks, ordered by (length, first rank). Of a run, ``each`` pieces
    stand side by side from ``offset`` on in every sequence from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank within it."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            lo, hi = np.searchsorted(self.length, [n, n + 1])
            run = lo + np.searchsorted(self.rank[lo:hi], rank[own], side="right") - 1
            within = rank[own] - self.rank[run]
            sequence[own] = self.sequence[run] + within // self.each[run]
            offset[own] = self.offset[run] + within % self.each[run] * n
        return sequence, offset


def plan_best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing over counts: the longest pieces first, each into the
    fullest open sequence that still takes it."""
    open_groups: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # by room left: (content, sequences)
    rooms: list[int] = []

    def put(room: int, content: tuple, n: int) -> None:
        if not open_groups[room]:
            bisect.insort(rooms, room)
        open_groups[room].append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                put(size, (), -(-left // (size // length)))
                continue
            room = rooms[at]
            content, n = open_groups[room].pop()
            if not open_groups[room]:
                rooms.pop(at)
            each = room // length  # what is left of the fullest stays the fullest
            whole = min(n, left // each)
            if whole:
                put(room - each * length, (*content, (length, each)), whole)
                left, n = left - whole * each, n - whole
            if n and left:
                put(room - left * length, (*content, (length, left)), 1)
                left, n = 0, n - 1
            if n:
                put(room, content, n)
    runs, ranks, sequence = [], defaultdict(int), 0
    for room in sorted(open_groups):
        for content, n in open_groups[room]:
            offset = 0
            for length, each in content:
                runs.append((length, ranks[length], each, sequence, offset))
                ranks[length] += each * n
                offset += each * length
            sequence += n
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (a ``length`` from 1 to ``size`` and any other columns) with
    sequence_id and offset.

    Ranks within a length are counted in as many parts as there are shuffle
    partitions, so that a length that most pieces have is no task of its own;
    ties are ranked in any order. ``pieces`` is read twice: give a table, not a
    long computation. No rows give no rows."""
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if pieces.schema[c].dataType.typeName() not in ("binary", "map", "variant")]
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(partitions(spark))))
    counts = dealt.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    plan = plan_best_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__part").orderBy(*keys)
    ranked = (
        dealt.withColumn("__rank", F.row_number().over(within))
        .join(bases, ["length", "__part"])
        .select(*pieces.columns, (F.col("__base") + F.col("__rank") - 1).alias("__rank"))
    )
    schema = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            sequence, offset = plan.place(length, rank)
            kept = batch.drop_columns(["__rank"])
            return pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"]
            )

        return convert

    return per_batch(ranked, f"struct<{schema}>", make)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids, one row per sequence: sequence_id, n_ids, ids (binary,
    little-endian unsigned 32-bit). A group has at most ``size`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
        .select("sequence_id", "n_ids", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents to packed pieces, without the ids. Texts are encoded once: the
    pieces' lengths and checksums are written to the shared folder."""
    return pack(written(token_pieces(docs, tokenizer, size, end_id), "pieces"), size)
