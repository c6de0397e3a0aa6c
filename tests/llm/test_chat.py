from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from tamis.llm import chat


def least_cost(roles, costs=chat.Costs()):
    best = chat.NEVER
    for labels in product((1, 2, 3), repeat=len(roles)):
        total, state = 0, chat.START
        for role, label in zip(roles, labels):
            total += costs.link(state, label)[0] + costs.relabel * (role != label)
            state = label
        best = min(best, total + costs.end()[state])
    return best


def check(conversations, found):
    """The cost is least, the turns are legal, and nothing of the texts is lost."""
    by = defaultdict(list)
    for r in found:
        by[r["conv_id"]].append(r)
    assert by.keys() == conversations.keys()
    for conv, turns in conversations.items():
        rows = sorted(by[conv], key=lambda r: (r["chunk"], r["place"]))
        if len(turns) < 9:
            assert sum(r["cost"] for r in rows) == least_cost([chat._code(r) for r, _ in turns])
        whole = "".join(r["rendered"] for r in rows)
        assert whole.endswith("<|end|>\n")
        parts = whole.split("<|end|>\n")[:-1]
        roles = [p[2 : p.index("|>")] for p in parts]
        for a, b in zip(["", *roles], roles):
            assert chat.ROLES.index(b) in chat.LEGAL[chat.ROLES.index(a)]
        assert roles[-1] == "assistant"
        kept = [r["rendered"].removesuffix("<|end|>\n") for r in rows if r["action"] != "insert"]
        assert all(p.endswith(t or "") for p, (_, t) in zip(kept, turns)) and len(kept) == len(turns)


def test_all_short_sequences(spark):
    names = ("system", "user", "assistant", None)
    conversations = {
        i: [(r, f"t{k}") for k, r in enumerate(roles)]
        for i, roles in enumerate(x for n in range(1, 6) for x in product(names, repeat=n))
    }
    rows = [(c, k, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(conversations, chat.format_conversations(df).collect())
    # cut into chunks of two turns, costs stay the least
    check(conversations, chat.format_conversations(df, chunk_turns=2).collect())


def test_given_conversations(spark, data, rows):
    conversations = defaultdict(list)
    for r in sorted(rows("conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        conversations[r["conv_id"]].append((r["role"], r["text"]))
    df = spark.read.parquet(f"{data}/conversations.parquet")
    check(conversations, chat.format_conversations(df).collect())


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a", 1), (None, 0, "user", "a", 1), (None, None, None, None, 1), (1, None, "assistant", None, 1)]
    rows += [(2, 3, "user", "same", 1)] * 3 + [(3, i, "user" if i % 2 == 0 else "assistant", "x" * i, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    found = chat.format_conversations(df, chunk_turns=100)
    alone = found.where("conv_id is null and action <> 'insert'")
    assert alone.count() == 3
    assert found.where("conv_id = 2 and action = 'merge'").count() == 2
    assert found.where("conv_id = 3").agg(F.sum("cost"), F.count("*")).first() == (0, 3000)
    assert chat.format_conversations(df.limit(0)).count() == 0
