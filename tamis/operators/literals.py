"""Which of many literals a text contains, by built-in functions.

A few literals are looked for one by one. More than FEW become one expression, a
tree of their letters: a text is read once, and at every place the tree says which
literal starts there. Time then hardly depends on how many there are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 64
DEPTH = 32  # letters of a literal that the tree holds
_BUCKETS = 256
_WIDE = 6  # branches tried one by one


def _letter(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def tree_regex(literals: Sequence[str]) -> str:
    """An expression for the longest of the literals that starts at a place."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(node: dict) -> str:
        parts = [(c, _letter(c) + rest(node[c])) for c in sorted(node) if c]
        return _either(parts)

    def rest(node: dict) -> str:
        if set(node) == {""}:
            return ""
        inner = branches(node)
        return f"(?:{inner})?" if "" in node else f"(?:{inner})" if len(node) > 1 else inner

    return branches(root)


def _either(parts: list[tuple[str, str]]) -> str:
    """Alternatives by first letter; many are told apart in groups first."""
    if len(parts) <= _WIDE:
        return "|".join(regex for _, regex in parts)
    size = max(-(-len(parts) // _WIDE), 2)
    groups = [parts[i : i + size] for i in range(0, len(parts), size)]
    return "|".join(f"(?=[{''.join(_letter(c) for c, _ in g)}])(?:{_either(g)})" for g in groups)


def literal_tests(text: Column, wanted: Sequence[Sequence[str] | None]) -> list[Column]:
    """For each entry whether the text has one of its literals; true for None
    and where one is empty."""
    literals = {x for w in wanted if w is not None for x in w}
    found = {x: F.contains(text, F.lit(x)) for x in literals}
    tests = []
    for w in wanted:
        always = w is None or "" in w
        hit = F.lit(always)
        for x in () if always else w:
            hit = hit | found[x]
        tests.append(hit)
    return tests


def ordinals(text: Column, wanted: Sequence[Sequence[str] | None], few: int = FEW) -> Column:
    """Ascending positions in ``wanted`` of the entries that have a literal in
    the text, and of those that are None or hold the empty literal. Null text
    has only these. With more than ``few`` literals, one of more than DEPTH
    letters is looked for by its beginning."""
    always = [i for i, w in enumerate(wanted) if w is None or "" in w]
    some = {i: w for i, w in enumerate(wanted) if w is not None and "" not in w}
    literals = {x for w in some.values() for x in w}
    if len(literals) <= few:
        tests = [F.when(hit, F.lit(i)) for i, hit in enumerate(literal_tests(text, wanted))]
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")

    of: dict[str, set[int]] = {}
    for i, w in some.items():
        for x in w:
            of.setdefault(x[:DEPTH], set()).add(i)
    # where a literal starts, so do those that it starts with
    whole = {x: sorted(set().union(*(of.get(x[:n], ()) for n in range(1, len(x) + 1)))) for x in of}
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for x, entries in whole.items():
        buckets[zlib.crc32(x.encode()) % _BUCKETS][x] = entries
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")
    # most places are left at their first letter, by one test ahead of the tree
    first = f"(?=[{''.join(sorted({_letter(x[0]) for x in of}))}])"
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{first}(?=({tree_regex(sorted(of))}))"), F.lit(1)))
    met = F.flatten(F.transform(starts, lambda x: F.get(table, (F.crc32(x) % _BUCKETS).cast("int"))[x]))
    met = F.coalesce(met, F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(met, F.array(*map(F.lit, always)).cast("array<int>"))))
