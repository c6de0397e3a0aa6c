"""A Merkle manifest of a data set whose parents keep hash states.

A parent is the SHA-256 of its children's hex digests, at most eight, and each
of these is one block. So a parent keeps, for each child's slot, the state
before that slot. To replace a child, hashing resumes there with the replacement
and the siblings right of it; nothing left of it is read again.

Leaves are numbered within their tree (a language) by two counts: in ranges
of rows, and of ranges before. Every 8 ** FOLDS leaves are a block, which one task
turns into FOLDS levels of parents, and folds through. Blocks are the nodes of the
next step, until each tree has one. What lies above a block is its path: by level,
its slot, the state kept for that slot and the digests of the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm import sha_state
from tamis.llm.tables import ascii_lower, partitions, written

RUN, FOLDS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 1 << 15  # handled at once; whole blocks
_LEVEL = 2 + 8 + 8 * RUN  # words of one level of a path: slot, size of the run, state, digests


def leaf(*values: Column) -> Column:
    """The hash of values with their lengths; ``-`` stands for null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _steps(n: np.ndarray, folds: int) -> np.ndarray:
    """How many levels lie between ``n`` nodes and their root, ``folds`` at most."""
    return sum((n > RUN**i).astype(np.int64) for i in range(folds))


class Level:
    """What one level adds to a path: for every row its slot, the number of
    nodes in its run, the state kept for the slot, and the run's digests."""

    def __init__(self, slot: np.ndarray, size: np.ndarray, state: np.ndarray, run: np.ndarray):
        self.slot, self.size, self.state, self.run = slot, size, state, run

    def fold(self, digest: np.ndarray) -> np.ndarray:
        """The parent's digest after a replacement."""
        state = sha_state.absorb(self.state, sha_state.hex_block(digest))
        for s in range(1, RUN):
            right = np.flatnonzero((self.slot < s) & (s < self.size))
            if len(right):
                state[right] = sha_state.absorb(state[right], sha_state.hex_block(self.run[right, s]))
        return sha_state.finish(state, self.size)

    def prove(self, state: np.ndarray) -> np.ndarray:
        """A proof's state after the siblings of this level."""
        state = state.copy()
        for s in range(RUN):
            others = np.flatnonzero((self.slot != s) & (s < self.size))
            if len(others):
                state[others] = sha_state.absorb(state[others], sha_state.hex_block(self.run[others, s]))
        return state

    def words(self) -> np.ndarray:
        small = np.stack([self.slot, self.size], axis=1).astype(np.uint32)
        return np.concatenate([small, self.state, self.run.reshape(len(small), -1)], axis=1)

    @classmethod
    def of_words(cls, w: np.ndarray) -> Level:
        return cls(w[:, 0].astype(np.int64), w[:, 1].astype(np.int64), w[:, 2:10], w[:, 10:].reshape(-1, RUN, 8))


def _grow(digest: np.ndarray, block: np.ndarray, place: np.ndarray, levels: int) -> tuple[list[Level], np.ndarray]:
    """Parents over rows of whole blocks, in order, all of as many levels. The
    levels as each row sees them, and the digest that its block ends in."""
    found, own = [], np.arange(len(digest))  # the node above each row
    for _ in range(levels):
        slot, parent = place % RUN, place // RUN
        new = np.ones(len(place), bool)
        new[1:] = (block[1:] != block[:-1]) | (parent[1:] != parent[:-1])
        of = np.cumsum(new) - 1
        size = np.bincount(of)
        run = np.zeros((len(size), RUN, 8), np.uint32)
        run[of, slot] = digest
        state = np.tile(sha_state.START, (len(size), 1))
        kept = np.zeros((len(size), RUN, 8), np.uint32)
        for s in range(RUN):
            kept[:, s] = state
            live = np.flatnonzero(size > s)
            if len(live):
                state[live] = sha_state.absorb(state[live], sha_state.hex_block(run[live, s]))
        at = of[own]
        found.append(Level(slot[own], size[at], kept[at, slot[own]], run[at]))
        digest, block, place, own = sha_state.finish(state, size), block[new], parent[new], at
    return found, digest[own]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about _ROWS rows that do not cut a block; rows come in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < _ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        tree, at = rows["tree"][-1], rows["block"][-1]
        end = rows.num_rows
        while end and rows["block"][end - 1] == at and rows["tree"][end - 1] == tree:
            end -= 1
        held = rows.slice(end).to_batches()
        if end:
            yield rows.slice(0, end)
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rows


def _by_block(nodes: DataFrame, schema: str, folds: int, convert: Callable[[pa.Table, list, np.ndarray], pa.Table]) -> DataFrame:
    """``convert`` over whole blocks of ``nodes`` (tree, n, place, digest, ...)."""

    span = RUN**folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            n, place = (rows[c].to_numpy().astype(np.int64) for c in ("n", "place"))
            steps = _steps(n, folds)
            for levels in np.unique(steps):
                chosen = np.flatnonzero(steps == levels)
                part = rows.take(pa.array(chosen))
                digest = sha_state.to_words(part["digest"].to_pylist())
                # neighbours of different trees differ in their place or in their tree
                tree = part["tree"].combine_chunks().dictionary_encode().indices.to_numpy()
                at = place[chosen] // span
                block = np.cumsum(np.concatenate([[0], (np.diff(tree) != 0) | (np.diff(at) != 0)]))
                found, top = _grow(digest, block, place[chosen] % span, int(levels))
                yield from convert(part, found, top).to_batches()

    rows = nodes.withColumn("block", F.expr(f"place div {span}"))
    ordered = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return ordered.mapInArrow(run, schema)


def _numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``place``, their number within their tree, and ``n``, the
    tree's size. No tree is ordered by one task: ranges of rows count for
    themselves, then only the counts of ranges are added up."""
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), tree, *order)
    ranges = written(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(tree, "part").agg(F.count("*").alias("here"))
    of_tree = Window.partitionBy(tree)
    before = F.sum("here").over(of_tree.orderBy("part")) - F.col("here")
    counts = counts.select(tree, "part", before.alias("before"), F.sum("here").over(of_tree).alias("n"))
    own = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order)) - 1
    return ranges.withColumn("own", own).join(counts, [tree, "part"]).withColumn("place", F.col("before") + F.col("own")).drop("part", "own", "before")


def _blocks_of(column: str, span: int) -> Column:
    return F.expr(f"{column} div {span} + if({column} % {span} > 0, 1, 0)")


def _climb(nodes: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """From ``nodes`` (tree, n, place, digest) to the roots (tree, digest) and
    the path of each node (tree, place, path)."""

    def convert(part: pa.Table, found: list[Level], top: np.ndarray) -> pa.Table:
        path = np.concatenate([x.words() for x in found], axis=1) if found else np.zeros((part.num_rows, 0), np.uint32)
        columns = {c: part[c] for c in ("tree", "n", "place")}
        columns["path"] = pa.array([row.tobytes() for row in path.astype("<u4")], pa.binary())
        columns["digest"] = pa.array(sha_state.to_bytes(top), pa.binary())
        return pa.table(columns)

    steps, span = [], RUN**folds
    while True:
        done = written(_by_block(nodes, "tree string, n bigint, place bigint, path binary, digest binary", folds, convert), "paths")
        steps.append(done)
        tops = done.where(f"place % {span} = 0").select(
            "tree", "digest", _blocks_of("n", span).alias("n"), F.expr(f"place div {span}").alias("place")
        )
        if (done.agg(F.max("n")).first()[0] or 0) <= span:
            break
        nodes = tops
    paths = steps[-1].select("tree", "place", "path")
    for below in reversed(steps[:-1]):
        above = paths.select("tree", F.col("place").alias("up"), F.col("path").alias("rest"))
        both = below.withColumn("up", F.expr(f"place div {span}")).join(above, ["tree", "up"])
        paths = both.select("tree", "place", F.concat("path", "rest").alias("path"))
    return tops.select("tree", "digest"), paths


_FOLDED = "doc_id bigint, leaf string, tree string, up bigint, n bigint, digest binary, folded binary, proof binary, blocks bigint"


def _fold_low(leaves: DataFrame, folds: int) -> DataFrame:
    """Leaves folded up to their block."""

    def convert(part: pa.Table, found: list[Level], top: np.ndarray) -> pa.Table:
        digest = sha_state.to_words(part["changed"].to_pylist())
        proof, blocks = np.tile(sha_state.START, (part.num_rows, 1)), np.zeros(part.num_rows, np.int64)
        for level in found:
            digest, proof, blocks = level.fold(digest), level.prove(proof), blocks + level.size - 1
        columns = {c: part[c] for c in ("doc_id", "leaf", "tree")}
        columns |= {"up": part["block"], "n": part["n"], "digest": pa.array(sha_state.to_bytes(top), pa.binary())}
        columns |= {"folded": pa.array(sha_state.to_bytes(digest), pa.binary()), "proof": pa.array(sha_state.to_bytes(proof), pa.binary())}
        return pa.table(columns | {"blocks": pa.array(blocks)})

    return _by_block(leaves, _FOLDED, folds, convert)


def _fold_high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of the way, along each row's path."""
    for whole in batches:
        for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
            digest, proof = (sha_state.to_words(batch[c].to_pylist()) for c in ("folded", "proof"))
            blocks = batch["blocks"].to_numpy(zero_copy_only=False).copy()
            paths = batch["path"].to_pylist()
            length = np.array([len(p) // (4 * _LEVEL) for p in paths])
            for i in range(length.max(initial=0)):
                rows = np.flatnonzero(length > i)
                at = slice(4 * _LEVEL * i, 4 * _LEVEL * (i + 1))
                words = np.frombuffer(b"".join(paths[r][at] for r in rows), "<u4").reshape(-1, _LEVEL)
                level = Level.of_words(words.astype(np.uint32))
                digest[rows], proof[rows] = level.fold(digest[rows]), level.prove(proof[rows])
                blocks[rows] += level.size - 1
            hexes = lambda words: pa.array([b.hex() for b in sha_state.to_bytes(words)], pa.string())
            columns = [batch["doc_id"], batch["leaf"], batch["subroot"], hexes(sha_state.finish(proof, blocks)), hexes(digest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(
    docs: DataFrame, tampered: Column, changed_text: Column | None = None, folds: int = FOLDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified.

    A leaf hashes FIELDS. The leaves of a language ascend by doc_id, null first,
    rows of one id by their leaf; runs of eight become a node until one is left,
    the subroot. Subroots, ordered by language (null first), become the root in the
    same way. proof_sha256 hashes a leaf's siblings from the leaf up. folded_root
    is recomputed from the leaf, with the text ``changed_text`` (lower-cased A-Z)
    where ``tampered`` holds, and the original siblings; null counts as not
    tampered. Nulls and empty texts have their own leaves; repeated rows are
    leaves each. An empty table gives no rows; other columns are not read."""
    values = [F.col(c) for c in FIELDS]
    changed = [*values[:-1], ascii_lower(F.col("text")) if changed_text is None else changed_text]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"),
        leaf(*values).alias("leaf"),
        F.when(tampered, leaf(*changed)).alias("changed"),
    )
    leaves = _numbered(rows, "tree", "doc_id", "leaf").withColumns(
        {"digest": F.unhex("leaf"), "changed": F.unhex(F.coalesce("changed", "leaf"))}
    )
    low = written(_fold_low(leaves, folds), "folded")
    blocks = low.groupBy("tree", "up").agg(F.first("n").alias("n"), F.first("digest").alias("digest"))
    blocks = blocks.select("tree", _blocks_of("n", RUN**folds).alias("n"), F.col("up").alias("place"), "digest")
    subroots, paths = _climb(blocks, folds)
    subroots = written(subroots, "subroots")
    every = _numbered(subroots.select(F.lit("").alias("every"), "tree", F.col("digest").alias("subroot")), "every", "tree")
    tops = written(every, "trees").select(F.col("every").alias("tree"), F.col("tree").alias("lang"), "n", "place", F.col("subroot").alias("digest"))
    roots, above = _climb(tops.drop("lang"), folds)
    root = roots.select(F.lower(F.hex("digest"))).first()
    langs = tops.join(above.drop("tree"), "place").select(
        F.col("lang").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), F.col("path").alias("rest")
    )
    whole = paths.join(langs, "tree").select("tree", F.col("place").alias("up"), "subroot", F.concat("path", "rest").alias("path"))
    folded = low.select("doc_id", "leaf", "tree", "up", "folded", "proof", "blocks").join(written(whole, "paths"), ["tree", "up"])
    found = folded.drop("tree", "up").mapInArrow(_fold_high, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "proof_sha256", "folded_root"
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
