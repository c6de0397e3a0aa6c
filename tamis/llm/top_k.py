"""Exact top-k inner products through a vector-approximation file.

Vectors of integers are approximated by the cell each component lies in. A scan
of the cells bounds every product from both sides; exact vectors are read in the
order of these bounds until no other can be among the k best. Equal vectors are
one row of the file with their smallest ids, so ties and copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.tables import partitions, per_batch, written

ROWS, QUERIES, SLICE = 8192, 1024, 64


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component. Rows without an id,
    null vectors and those with null or non-finite components are left out."""
    e = F.col("embedding")
    sound = F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    ints = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound).select(
        F.col("vec_id").cast("bigint"), ints.alias("ints")
    )


def _distinct(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(v, ints, ids, is_query): each vector once, with its k + 1 smallest ids:
    enough for every query, its own id among them."""
    once = rows.groupBy("ints", "vec_id").agg(F.lit(1).alias("one"))
    flagged = once.select("ints", "vec_id", is_query.alias("is_query"))
    queries = flagged.groupBy("ints").agg(F.max("is_query").alias("is_query"))
    first = flagged.withColumn("r", F.row_number().over(Window.partitionBy("ints").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("ints").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.join(queries, "ints").select(F.monotonically_increasing_id().alias("v"), "ints", "ids", "is_query")


def _ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest component by number of dimensions and place: one row
    per batch and dimension is aggregated, one per dimension comes back."""

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for dims, at, values in _by_dims(batch):
                del at
                out += zip([dims] * dims, range(dims), values.min(axis=0).tolist(), values.max(axis=0).tolist())
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "d", "lo", "hi"])

        return convert

    found = per_batch(vectors.select("v", "ints"), "n bigint, d bigint, lo bigint, hi bigint", make)
    rows = found.groupBy("n", "d").agg(F.min("lo"), F.max("hi")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == n)
        out[n] = np.array([x[1] for x in own]), np.array([x[2] for x in own])
    return out


def _by_dims(batch: pa.RecordBatch):
    """(dimensions, row numbers, matrix) for each number of dimensions above zero."""
    lists = batch["ints"]
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for dims in np.unique(sizes):
        at = np.nonzero(sizes == dims)[0]
        if dims:
            yield int(dims), at, flat[offsets[at][:, None] + np.arange(dims)]


def _packed(vectors: DataFrame, rows: int, encode) -> DataFrame:
    """Blocks of at most ``rows`` vectors: (dims, block, vs, data). ``encode``
    makes bytes of a matrix."""

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch["v"].to_numpy()
            out: list[list] = [[], [], [], []]
            for dims, at, values in _by_dims(batch):
                for i in range(0, len(at), rows):
                    own = v[at[i : i + rows]]
                    for column, cell in zip(out, (dims, int(own[0]), own.tobytes(), encode(dims, values[i : i + rows]))):
                        column.append(cell)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["dims", "block", "vs", "data"])

        return convert

    return per_batch(vectors.select("v", "ints"), "dims bigint, block bigint, vs binary, data binary", make)


def _bounds(pairs: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """For each pair of a row block and a query block: (q, v, low, high) of the
    vectors whose upper bound reaches the k-th lower bound within the block."""

    def make():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[np.ndarray, ...]] = []
            for row in range(batch.num_rows):
                dims = batch["dims"][row].as_py()
                lo, width = cells[dims]
                v, q = (np.frombuffer(batch[c][row].as_py(), np.int64) for c in ("vs", "qs"))
                codes = np.frombuffer(batch["data"][row].as_py(), np.uint8).reshape(-1, dims)
                centre = lo + (codes + 0.5) * width
                queries = np.frombuffer(batch["query"][row].as_py(), np.int64).reshape(-1, dims).astype(np.float64)
                slack = np.abs(queries) @ width / 2
                slack += 1e-9 * (np.abs(queries) @ (np.abs(lo) + 256 * width)) + 1e-6
                for i in range(0, len(q), SLICE):
                    middle = queries[i : i + SLICE] @ centre.T
                    s = slack[i : i + SLICE]
                    kth = -min(k, len(v))
                    least = np.partition(middle, kth, axis=1)[:, kth]
                    a, b = np.nonzero(middle + 2 * s[:, None] >= least[:, None])
                    m = middle[a, b]
                    out.append((q[i + a], v[b], m - s[a], m + s[a]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (int, int, float, float)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "v", "low", "high"])

        return convert

    return per_batch(pairs, "q bigint, v bigint, low double, high double", make)


def grid(n_blocks: int, tasks: int) -> tuple[int, int]:
    """(parts of the query blocks, groups of row blocks). A row block is copied
    once per part, so there are at most as many parts as the root of the tasks,
    however many queries ask."""
    parts = max(1, min(n_blocks, math.isqrt(tasks)))
    return parts, max(1, tasks // parts)


def _best(pairs: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their rank; cut before the shuffle, too."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, bits: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (of
    vec_id) holds, the k others of highest integer inner product, ties to the
    smaller vec_id.

    Rows that :func:`integer_vectors` leaves out take no part. Only vectors of
    as many components are compared, those of none never. A repeated row counts
    once. An id with several vectors asks with each of them and gets the k best
    of all their answers; its own further vectors take places among these before
    they are left out, and as an answer an id may stand once per vector. Row
    blocks meet query blocks in an equi-join on (row group, query
    block); this is the stated query set against all rows, in blocks."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    found = written(_distinct(rows, is_query, k), "vectors")
    ranges = _ranges(found)
    cells = {}
    for dims, (lo, hi) in ranges.items():
        cells[dims] = lo.astype(np.float64), np.maximum((hi - lo + 1) / (1 << bits), 1.0)

    def code(dims: int, values: np.ndarray) -> bytes:
        lo, width = cells[dims]
        return np.minimum(np.floor((values - lo) / width), (1 << bits) - 1).astype(np.uint8).tobytes()

    queries = found.where("is_query")
    n_blocks = max(1, -(-queries.count() // QUERIES))
    parts, groups = grid(n_blocks, partitions(spark))
    asked = written(
        _packed(queries.repartition(n_blocks, "v"), QUERIES, lambda dims, values: values.tobytes()), "queries"
    )
    approximation = written(_packed(found, ROWS, code), "approximation")
    # each row block once per part of the query blocks, each query block once per group of row blocks;
    # within a task, the blocks of one key meet without moving again
    left = approximation.select(
        "dims", "vs", "data", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"),
    )
    right = asked.select(
        "dims", F.col("vs").alias("qs"), F.col("data").alias("query"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"),
        F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"),
    )
    pairs = left.join(right, ["dims", "g", "part"]).select("dims", "vs", "data", "qs", "query")
    candidates = written(_bounds(pairs, cells, k + 1), "candidates")
    certain = _best(candidates, "q", [F.desc("low")], k + 1).groupBy("q").agg(F.min("low").alias("least"))
    possible = candidates.join(certain, "q").where("high >= least").select("q", "v", "high")

    def exact(part: DataFrame) -> DataFrame:
        q = found.select(F.col("v").alias("q"), F.col("ints").alias("a"))
        v = found.select("v", F.col("ints").alias("b"), "ids")
        product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return part.join(v, "v").join(q, "q").select("q", "v", "ids", product.alias("score"))

    # the most promising first; what is left only where it can still reach the k-th of these
    ordered = possible.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("high"), "v")))
    ordered = written(ordered, "ordered")
    head = written(exact(ordered.where(F.col("place") <= 2 * (k + 1))), "head")
    reached = _best(head, "q", [F.desc("score")], k + 1).groupBy("q").agg(
        F.min("score").alias("kth"), F.count("*").alias("n")
    )
    rest = ordered.where(F.col("place") > 2 * (k + 1)).join(reached, "q").where((F.col("high") >= F.col("kth")) | (F.col("n") <= k))
    scored = head.unionByName(exact(rest.select("q", "v", "high")))
    by_id = scored.select("q", F.explode("ids").alias("vec_id"), "score")
    best = _best(by_id, "q", [F.desc("score"), F.asc("vec_id")], k + 1).drop("rank")
    asking = rows.where(is_query).distinct().join(queries.select(F.col("v").alias("q"), "ints"), "ints")
    answers = asking.select("q", F.col("vec_id").alias("query_id")).join(best, "q").where("query_id <> vec_id")
    return _best(answers, "query_id", [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")
