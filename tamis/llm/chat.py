"""Chat formatting with minimum-cost role repair.

Legal conversations are those of a small automaton: an optional system turn,
then user and assistant turns in alternation, the assistant last. Every turn may
be relabelled, may be merged with the one before, and empty turns may be
inserted; dynamic programming finds the cheapest way, which is then rendered.

A long conversation is cut into chunks of turn numbers. The costs of a chunk are
a 4 x 4 matrix from the state before to the state behind; chaining the matrices
gives each chunk the states it has to start and end in, and all chunks are then
repaired side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import partitions, written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    merge: int = 1
    insert: int = 2

    def link(self, before: int, role: int) -> tuple[int, str]:
        """From the state before to a turn of ``role``: cost and what is done."""
        ways = [(0, "keep")] if role in LEGAL[before] else []
        if before == role:
            ways.append((self.merge, "merge"))
        if any(role in LEGAL[x] for x in LEGAL[before]):
            ways.append((self.insert, "insert"))
        return min(ways, default=(NEVER, "never"))

    def turn(self, role: int) -> list[list[int]]:
        """Costs of a turn labelled ``role`` (0: no known one) by state before and state behind."""
        return [
            [NEVER if q == START else self.link(s, q)[0] + self.relabel * (q != role) for q in range(4)]
            for s in range(4)
        ]

    def end(self) -> list[int]:
        return [0, 2 * self.insert, self.insert, 0]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(a[s][m] + b[m][e] for m in range(4)) for e in range(4)] for s in range(4)]


def repair(roles: list[int], costs: Costs, entry: int, exit_state: int | None) -> list[int]:
    """The cheapest roles, ending in ``exit_state`` or, if None, at the conversation's end."""
    tables = [costs.turn(r) for r in range(4)]
    now = [0 if s == entry else NEVER for s in range(4)]
    back = []
    for role in roles:
        table = tables[role]
        steps = [min((now[s] + table[s][q], s) for s in range(4)) for q in range(4)]
        now, came = [x[0] for x in steps], [x[1] for x in steps]
        back.append(came)
    state = min(range(4), key=lambda s: (now[s] + costs.end()[s], s)) if exit_state is None else exit_state
    out = []
    for came in reversed(back):
        out.append(state)
        state = came[state]
    return out[::-1]


def _code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES[1:] else 0


_OUT = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("place", pa.int32()), ("turn", pa.int64()), ("role", pa.string())]
    + [("new_role", pa.string()), ("action", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())]
)
_DDL = "conv_id bigint, chunk bigint, place int, turn bigint, role string, new_role string, action string, cost int, rendered string"


def rendered_rows(chunk: list[tuple], costs: Costs, entry: int, exit_state: int | None) -> Iterator[tuple]:
    """Rows (turn, role, new role, action, cost, text piece) of (turn, role,
    text) rows in order. The pieces of a conversation, joined, are its text: a
    turn is closed by the piece that opens the next, the last one by itself."""
    before = entry
    opened = lambda s, role, text: ("<|end|>\n" if s != START else "") + f"<|{ROLES[role]}|>\n{text}"
    out = []
    for (turn, role, text), q in zip(chunk, repair([_code(r) for _, r, _ in chunk], costs, entry, exit_state)):
        cost, how = costs.link(before, q)
        if how == "insert":
            between = next(x for x in LEGAL[before] if q in LEGAL[x])
            out.append([turn, None, ROLES[between], "insert", costs.insert, opened(before, between, "")])
            before, cost = between, 0
        actions = (["relabel"] if role != ROLES[q] else []) + (["merge"] if how == "merge" else [])
        piece = f"\n\n{text or ''}" if how == "merge" else opened(before, q, text or "")
        out.append([turn, role, ROLES[q], "+".join(actions) or "keep", cost + costs.relabel * (role != ROLES[q]), piece])
        before = q
    if exit_state is None:
        while before != ASSISTANT:
            between = LEGAL[before][0]
            out.append([chunk[-1][0], None, ROLES[between], "insert", costs.insert, opened(before, between, "")])
            before = between
        out[-1][-1] += "<|end|>\n"
    yield from map(tuple, out)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys, across batches."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    for key, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(group)


def _states(keyed: DataFrame, costs: Costs) -> DataFrame:
    """(conv_id, chunk, entry, exit, last) of conversations of several chunks."""
    ids = keyed.where("conv_id is not null").groupBy("conv_id")
    several = ids.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("conv_id")
    order = ["conv_id", "chunk", "turn", "role", "h"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [costs.turn(r) for r in range(4)]
        for (conv, chunk), rows in _runs(batches, ["conv_id", "chunk"]):
            m = tables[_code(rows[0]["role"])]
            for r in rows[1:]:
                m = product(m, tables[_code(r["role"])])
            cells = [pa.array([conv]), pa.array([chunk]), pa.array([sum(m, [])], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, ["conv_id", "chunk", "m"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _runs(batches, ["conv_id"]):
            now, back = [0, NEVER, NEVER, NEVER], []
            for r in rows:
                steps = [min((now[s] + r["m"][4 * s + e], s) for s in range(4)) for e in range(4)]
                now = [x[0] for x in steps]
                back.append([x[1] for x in steps])
            state = min(range(4), key=lambda s: (now[s] + costs.end()[s], s))
            out = []
            for r, came in zip(reversed(rows), reversed(back)):
                out.append((conv, r["chunk"], came[state], state, not out))
                state = came[state]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["conv_id", "chunk", "entry", "exit", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    narrow = keyed.select(*order).join(several, "conv_id", "left_semi")
    parts = narrow.repartition("conv_id", "chunk").sortWithinPartitions(*order)
    of_chunks = parts.mapInArrow(matrices, "conv_id bigint, chunk bigint, m array<bigint>")
    chained = of_chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return chained.mapInArrow(chain, "conv_id bigint, chunk bigint, entry int, exit int, last boolean")


def format_conversations(conversations: DataFrame, costs: Costs = Costs(), chunk_turns: int = 1024) -> DataFrame:
    """One row per turn, and one per inserted empty turn: conv_id, chunk, place
    (the order within a conversation is by chunk, then place), turn, role,
    new_role, action, cost and rendered.

    Turns are ordered by number, ties by role and checksum of the text; repeated
    rows are turns of their own. Roles other than system, user and assistant,
    null among them, have to be relabelled. Null text is empty. A row without
    conv_id is a conversation of its own; a null turn comes first. Among equally
    cheap repairs one is chosen that does not depend on other conversations. An
    empty table gives no rows; other columns are not read."""
    spark = conversations.sparkSession
    turn = F.col("turn").cast("bigint")
    chunk = F.coalesce(F.floor(turn / F.lit(chunk_turns)), F.lit(-(1 << 62)))
    h = F.xxhash64("text")
    alone = F.pmod(F.xxhash64("turn", "role", "text"), F.lit(1 << 20))
    keyed = conversations.select(
        F.col("conv_id").cast("bigint"), turn.alias("turn"), "role", "text", h.alias("h"),
        F.when(F.col("conv_id").isNull(), alone).otherwise(chunk).alias("chunk"),
    )
    states = written(_states(keyed, costs), "chunk-states")
    dealt = keyed.repartition(partitions(spark), "conv_id", "chunk")
    rows = dealt.join(states.hint("shuffle_hash"), ["conv_id", "chunk"], "left").select(
        "conv_id", "chunk", "turn", "role", "text", "h", "entry", "exit", "last"
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for (conv, chunk_id), found in _runs(batches, ["conv_id", "chunk"]):
            first = found[0]
            entry = first["entry"] if first["entry"] is not None else START
            exit_state = first["exit"] if first["last"] is False else None
            for part in [[r] for r in found] if conv is None else [found]:
                turns = [(r["turn"], r["role"], r["text"]) for r in part]
                new = [(conv, chunk_id, i, *r) for i, r in enumerate(rendered_rows(turns, costs, entry, exit_state))]
                out += new
                size += sum(len(r[-1]) for r in new)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)

    return rows.sortWithinPartitions("conv_id", "chunk", "turn", "role", "h").mapInArrow(render, _DDL)
