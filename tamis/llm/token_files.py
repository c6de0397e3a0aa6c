"""Token ids in files: documents compressed one by one with a shared dictionary.

Format: a folder with two Parquet tables. ``dictionary`` has one row (hash,
data). ``blocks`` has one row per block of about a megabyte: shard, block,
first_doc, last_doc, shard_start (ids of the shard before it), n_tokens,
dict_hash, the blob of joined frames and its index, an array of (doc_id,
offset, n_bytes, n_tokens). Shards follow one another in doc_id order. A reader
of one document prunes blocks by first_doc and last_doc, reads one index and
decompresses one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.tables import chunks, partitions, per_batch
from tamis.llm.token_ids import encoder

BLOCK_BYTES = 1 << 20
_BLOCKS = (
    "shard int, block int, first_doc bigint, last_doc bigint, shard_start bigint, n_tokens bigint, dict_hash string, "
    "blob binary, index array<struct<doc_id: bigint, offset: int, n_bytes: int, n_tokens: bigint>>"
)
_INDEX = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("n_bytes", pa.int32()), ("n_tokens", pa.int64())])
)
_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]
    + [("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("blob", pa.binary())]
    + [("index", _INDEX)]
)
_IDS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def packed_ids(ids: bytes, width: int) -> bytes:
    """Unsigned 32-bit ids in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(
    docs: DataFrame, tokenizer: str, width: int, samples: int = 1000, sample_bytes: int = 8192, size: int = 1 << 16
) -> bytes:
    """A zstandard dictionary for serialized ids, or b"" where there is too
    little to learn from. It is fitted on the ``samples`` documents of smallest
    hash and ``sample_bytes`` of each, at most 8 MB in all."""
    import zstandard

    hashed = docs.select(F.xxhash64("doc_id").alias("h"))
    last = hashed.orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    if last is None:
        return b""

    def make():
        encode = encoder(tokenizer).encode

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [
                packed_ids(encode(x), width)[:sample_bytes]
                for part in chunks(batch, "text")
                for x in part["text"].to_pylist()
            ]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["ids"])

        return convert

    chosen = docs.where(F.col("text").isNotNull() & (F.xxhash64("doc_id") <= last)).select("text").limit(samples)
    rows = per_batch(chosen, "ids binary", make).collect()
    pieces = [bytes(r[0][i : i + 1024]) for r in rows for i in range(0, len(r[0]), 1024)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, level: int = 3) -> None:
    """Encode every whole text and write the files in ascending doc_id order.

    Null text counts as empty, so every row is a document of at least the end
    id; null doc_ids come first; rows of equal doc_id keep together in any
    order; other columns are not read. One shuffle moves the texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    width = 2 if max(end_id + 1, encoder(tokenizer).whole.get_vocab_size()) <= 1 << 16 else 4
    learned = train_dictionary(docs, tokenizer, width)
    digest = hashlib.sha256(learned).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(learned))], "hash string, width int, data binary").coalesce(
        1
    ).write.parquet(f"{folder}/dictionary")
    end = end_id.to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode = encoder(tokenizer).encode
        compress = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(learned) if learned else None
        ).compress
        shard, block, start, total, size = TaskContext.get().partitionId(), 0, 0, 0, 0
        frames, index = [], []

        def flush() -> pa.RecordBatch:
            row = [shard, block, index[0][0], index[-1][0], start, total, digest, b"".join(frames)]
            cells = [pa.array([v], t) for v, t in zip(row, _ARROW.types)]
            entries = [dict(zip(("doc_id", "offset", "n_bytes", "n_tokens"), x)) for x in index]
            return pa.RecordBatch.from_arrays([*cells, pa.array([entries], _INDEX)], schema=_ARROW)

        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = encode(text or "") + end
                    frame = compress(packed_ids(ids, width))
                    index.append((doc, size, len(frame), len(ids) // 4))
                    frames.append(frame)
                    size, total = size + len(frame), total + len(ids) // 4
                    if size >= BLOCK_BYTES:
                        yield flush()
                        block, start, total, size, frames, index = block + 1, start + total, 0, 0, [], []
        if frames:
            yield flush()

    ordered = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, _BLOCKS).write.parquet(f"{folder}/blocks")


def _reader(spark: SparkSession, folder: str):
    """The frame decoder's width and dictionary, checked against its hash."""
    digest, width, data = spark.read.parquet(f"{folder}/dictionary").select("hash", "width", "data").first()
    if hashlib.sha256(bytes(data)).hexdigest() != digest:
        raise ValueError("the dictionary does not have its hash")
    return digest, width, bytes(data)


def _decode(blocks: DataFrame, spark: SparkSession, folder: str, wanted: set[int] | None, digest_only: bool) -> DataFrame:
    digest, width, learned = _reader(spark, folder)
    totals = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens"))
    bases, sum_before = {}, 0
    for shard, n in sorted(totals.collect()):  # one row per shard
        bases[shard], sum_before = sum_before, sum_before + n
    value = pa.int64() if digest_only else pa.binary()
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"]

    def make():
        import zstandard

        decompress = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(learned) if learned else None
        ).decompress

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                shard, start, own, blob, index = (
                    batch[c][row] for c in ("shard", "shard_start", "dict_hash", "blob", "index")
                )
                if own.as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                at, blob = bases[shard.as_py()] + start.as_py(), memoryview(blob.as_buffer())
                for e in index.as_py():
                    if wanted is None or e["doc_id"] in wanted:
                        raw = decompress(blob[e["offset"] : e["offset"] + e["n_bytes"]])
                        ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                        row_out = (e["doc_id"], at, len(ids), zlib.crc32(ids) if digest_only else ids.tobytes())
                        for values, v in zip(out, row_out):
                            values.append(v)
                    at += e["n_tokens"]
            types = [pa.int64(), pa.int64(), pa.int64(), value]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

        return convert

    columns = ["shard", "shard_start", "dict_hash", "blob", "index"]
    schema = _IDS.replace("ids binary", "ids_crc32 bigint") if digest_only else _IDS
    return per_batch(blocks.select(*columns), schema, make)


def read_token_files(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids as
    little-endian unsigned 32-bit binary, or only their crc32."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    return _decode(blocks, spark, folder, None, digest_only)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Only the given documents (a short list): blocks are pruned by their range
    and only the wanted frames are decompressed."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    hit = F.lit(False)
    for d in doc_ids:
        hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return _decode(blocks.where(hit), spark, folder, set(doc_ids), False)
