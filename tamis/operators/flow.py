"""Source-to-sink flow inside one file, as a fold over its lines.

A file never leaves its row: lines are an array column, functions are found by
a fold, and each scope is analysed by a fold whose state is the set of tainted
names. Everything is a built-in higher-order function, so there is no shuffle
and no Python on the way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import let, lines, trim_start_ws, trim_ws

IDENT = "[A-Za-z_][A-Za-z0-9_]*"
_WORD = "[\\p{IsAlphabetic}\\p{N}_]+"
_DOTTED = "[\\p{IsAlphabetic}\\p{N}_.]+"
# A call, and in a look-ahead all that follows its opening parenthesis.
_CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\s*\((?=(.*)$)"
# Both are applied to trimmed lines.
_DEF = rf"^def\s+({IDENT})\s*\(([^)]*)\)"
_BRACE_DEF = rf"({IDENT})\s*\([^;]*$"
_PLAIN_ASSIGNMENT = r"(?U)^[\w\s,]+\s*=\s*(.+)$"
# Words that are no variables, no functions, no parameters.
STATEMENT_WORDS = ("if", "for", "while", "return", "import", "from")
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "return", "elif", "else", "do")
RECEIVERS = ("self", "cls", "this")

_STATE = "struct<tainted:array<string>,hits:array<int>,leaks:boolean>"
_FUNCTIONS = "array<struct<name:string,params:array<string>,start:int,end:int>>"
_SPANS = "struct<level:int,starts:array<int>,ends:array<int>>"


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _all(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def _found(text: Column, regex: Column) -> Column:
    return F.coalesce(F.regexp_instr(text, regex) > 0, F.lit(False))


def _line(raw: Column, index: Column, roles: dict[str, Column], has: Column) -> Column:
    """What a line says by itself. Lists of names are only made where a later
    step may look at them."""

    def facts(t: Column) -> Column:
        has_eq = F.contains(t, F.lit("="))
        returns = F.startswith(t, F.lit("return"))
        ignored = (
            (t == "") | F.startswith(t, F.lit("#")) | F.startswith(t, F.lit("//"))
        )

        def with_roles(role: Column) -> Column:
            lhs = F.substring_index(t, "=", 1)
            rhs = F.substring(t, F.length(lhs) + 2, F.length(t))
            return F.struct(
                index.alias("at"),
                t.alias("t"),
                (F.octet_length(raw) - F.octet_length(trim_start_ws(raw))).alias("indent"),
                ignored.alias("ignored"),
                role["source"].alias("source"),
                role["sink"].alias("sink"),
                role["sanitizer"].alias("sanitizer"),
                has_eq.alias("has_eq"),
                returns.alias("returns"),
                F.when(has_eq, _all(lhs, IDENT)).otherwise(_strings()).alias("lhs"),
                F.when(has_eq & ~role["source"], _all(rhs, _WORD))
                .otherwise(_strings())
                .alias("rhs"),
                F.when(role["sink"] | returns, _all(t, _WORD)).otherwise(_strings()).alias("words"),
            )

        tested = [
            F.when(has[name] & ~ignored, _found(t, regex)).otherwise(False).alias(name)
            for name, regex in roles.items()
        ]
        return let(F.struct(*tested), with_roles)

    return let(trim_ws(raw), facts)


def _calls(t: Column) -> Column:
    """Short name and argument words of every call on the line."""
    return F.zip_with(
        F.regexp_extract_all(t, F.lit(_CALL), F.lit(1)),
        F.regexp_extract_all(t, F.lit(_CALL), F.lit(2)),
        lambda name, rest: F.struct(
            F.substring_index(name, ".", -1).alias("name"), _all(rest, _WORD).alias("args")
        ),
    )


def _is_brace_def(t: Column) -> Column:
    head = F.regexp_extract(t, "^([^ \t(]*)", 1)
    return (
        F.contains(t, F.lit("{"))
        & F.contains(t, F.lit("("))
        & ~F.endswith(t, F.lit(";"))
        & F.rlike(t, F.lit(_BRACE_DEF))
        & ~head.isin(*CONTROL_WORDS)
    )


def _nesting(t: Column) -> Column:
    count = lambda b: F.length(t) - F.length(F.replace(t, F.lit(b), F.lit("")))
    return count("{") - count("}")


def _params(raw: Column) -> Column:
    names = F.transform(
        F.split(raw, ",", -1),
        lambda p: F.regexp_extract(trim_ws(p), r"^\**([\p{IsAlphabetic}\p{N}_]*)", 1),
    )
    return F.filter(names, lambda n: (n != "") & ~n.isin(*RECEIVERS))


def _functions(rows: Column, spans: Column, brace: bool) -> Column:
    """Spans joined with the name and parameters on their first line."""

    def function(start: Column, end: Column) -> Column:
        t = F.element_at(rows, start + 1)["t"]
        if brace:
            name = F.regexp_extract(t, _BRACE_DEF, 1)
            params = F.regexp_extract(t, r"^[^(]*\((.*)\)", 1)
        else:
            name = F.regexp_extract(t, _DEF, 1)
            params = F.regexp_extract(t, _DEF, 2)
        return F.struct(
            name.alias("name"),
            _params(params).alias("params"),
            start.alias("start"),
            end.alias("end"),
        )

    found = let(spans, lambda s: F.zip_with(s["starts"], s["ends"], function))
    return found.cast(_FUNCTIONS)


def _push(array: Column, value: Column, when: Column) -> Column:
    return F.when(when, F.array_append(array, value)).otherwise(array)


def _spans(level: Column, starts: Column, ends: Column) -> Column:
    return F.struct(level.alias("level"), starts.alias("starts"), ends.alias("ends")).cast(_SPANS)


def _no_spans() -> Column:
    none = F.array().cast("array<int>")
    return _spans(F.lit(-1), none, none)


def _indented_functions(rows: Column) -> Column:
    """``def`` lines with the deeper or blank lines below them. The level is
    the indent of the open function, or -1."""

    def step(s: Column, l: Column) -> Column:
        is_open = s["level"] >= 0
        inside = is_open & ((l["t"] == "") | (l["indent"] > s["level"]))
        is_def = F.startswith(l["t"], F.lit("def")) & F.rlike(l["t"], F.lit(_DEF))
        return F.when(inside | ~(is_open | is_def), s).otherwise(
            _spans(
                F.when(is_def, l["indent"]).otherwise(-1),
                _push(s["starts"], l["at"], is_def),
                _push(s["ends"], l["at"], is_open),
            )
        )

    def close(s: Column) -> Column:
        return _spans(s["level"], s["starts"], _push(s["ends"], F.size(rows), s["level"] >= 0))

    return _functions(rows, F.aggregate(rows, _no_spans(), step, close), brace=False)


def _braced_functions(rows: Column) -> Column:
    """Definition-like lines up to the line that closes their braces. The level
    is the open brace depth, or -1."""

    def step(s: Column, l: Column) -> Column:
        is_open = s["level"] >= 0
        depth = F.greatest(s["level"], F.lit(0)) + _nesting(l["t"])

        def moved(depth: Column) -> Column:
            closes = depth <= 0
            return _spans(
                F.when(closes, -1).otherwise(depth),
                _push(s["starts"], l["at"], ~is_open),
                _push(s["ends"], l["at"] + 1, closes),
            )

        return F.when(is_open | _is_brace_def(l["t"]), let(depth, moved)).otherwise(s)

    def close(s: Column) -> Column:
        return _spans(s["level"], s["starts"], _push(s["ends"], F.size(rows), s["level"] >= 0))

    return _functions(rows, F.aggregate(rows, _no_spans(), step, close), brace=True)


def _state(tainted: Column, hits: Column, leaks: Column) -> Column:
    return F.struct(tainted.alias("tainted"), hits.alias("hits"), leaks.alias("leaks")).cast(_STATE)


def _analyse(rows: Column, seed: Column, leaky: Column, flat: Column) -> Column:
    """Fold one scope. ``leaky`` names functions that return tainted data. In a
    file without functions (``flat``) only plain assignments clean a name, and
    dotted names are one word."""

    def step(s: Column, l: Column) -> Column:
        cleans = F.when(flat, F.rlike(l["t"], F.lit(_PLAIN_ASSIGNMENT))).otherwise(l["has_eq"])
        cleaned = _state(
            F.when(cleans, F.array_except(s["tainted"], l["lhs"])).otherwise(s["tainted"]),
            s["hits"],
            s["leaks"],
        )

        def live(marked: Column) -> Column:
            from_call = (F.size(leaky) > 0) & F.exists(
                _calls(l["t"]),
                lambda c: F.array_contains(leaky, c["name"])
                & (
                    F.arrays_overlap(c["args"], marked)
                    | (F.size(c["args"]) == 0)
                    | l["source"]
                ),
            )

            def called(from_call: Column) -> Column:
                spreads = l["has_eq"] & ~l["source"] & (
                    from_call | F.arrays_overlap(l["rhs"], marked)
                )
                tainted = F.when(spreads, F.array_union(marked, l["lhs"])).otherwise(marked)
                return let(tainted, lambda t: seen(t, from_call))

            return let(from_call, called)

        def seen(tainted: Column, from_call: Column) -> Column:
            words = F.when(flat, _all(l["t"], _DOTTED)).otherwise(l["words"])
            reaches = l["sink"] & (
                l["source"]
                | from_call
                | F.exists(words, lambda w: F.exists(tainted, lambda t: F.endswith(w, t)))
            )
            leaks = l["returns"] & (
                l["source"] | from_call | F.arrays_overlap(l["words"], tainted)
            )
            return _state(
                tainted, _push(s["hits"], l["at"] + 1, reaches), s["leaks"] | leaks
            )

        named = F.array_except(l["lhs"], _strings(*STATEMENT_WORDS))
        flowing = let(
            F.when(l["source"], F.array_union(s["tainted"], named)).otherwise(s["tainted"]), live
        )
        # A line without any role or name to carry changes nothing.
        idle = l["ignored"] | ~(
            l["has_eq"] | l["sink"] | l["source"] | l["sanitizer"] | l["returns"]
        )
        return F.when(idle, s).when(l["sanitizer"], cleaned).otherwise(flowing)

    start = _state(seed, F.array().cast("array<int>"), F.lit(False))
    return F.aggregate(rows, start, step)


def _hits(rows: Column, fns: Column) -> Column:
    """First find the functions whose result is tainted when their parameters
    are, then scan the top level and all functions with that knowledge.

    Only what that can change is folded: a function again if it has a sink and
    some function leaks, the top level if something can start a flow there."""
    flat = F.size(fns) == 0

    def body(f: Column) -> Column:
        return F.slice(rows, f["start"] + 2, f["end"] - f["start"] - 1)

    def any_line(rs: Column, role: str) -> Column:
        return F.exists(rs, lambda l: l[role])

    def top_hits(leaky: Column) -> Column:
        # lines of functions as a set, so that no line meets every function
        covered = F.flatten(F.transform(fns, lambda f: F.sequence(f["start"], f["end"] - 1)))
        outside = F.array_except(F.transform(rows, lambda l: l["at"]), covered)
        top = F.when(flat, rows).otherwise(F.transform(outside, lambda at: F.element_at(rows, at + 1)))
        starts = (F.size(leaky) > 0) | any_line(rows, "source")

        def fold(top: Column) -> Column:
            return F.when(
                any_line(top, "sink"), _analyse(top, _strings(), leaky, flat)["hits"]
            ).otherwise(none)

        return F.when(starts, let(top, fold)).otherwise(none)

    def function_hits(leaky: Column, alone: Column) -> Column:
        def again(f: Column, a: Column) -> Column:
            changes = (F.size(leaky) > 0) & any_line(body(f), "sink")
            return F.when(
                changes, _analyse(body(f), f["params"], leaky, flat)["hits"]
            ).otherwise(a["hits"])

        return F.flatten(F.zip_with(fns, alone, again))

    none = F.array().cast("array<int>")
    alone = F.transform(fns, lambda f: _analyse(body(f), f["params"], _strings(), flat))

    def with_functions(alone: Column) -> Column:
        leaking = F.zip_with(fns, alone, lambda f, a: F.when(a["leaks"], f["name"]))
        return let(
            F.array_distinct(F.array_compact(leaking)),
            lambda leaky: F.concat(top_hits(leaky), function_hits(leaky, alone)),
        )

    return let(alone, with_functions)


def flow_lines(
    text: Column, lang: Column, source: Column, sink: Column, sanitizer: Column
) -> Column:
    """Sorted 1-based lines on which tainted data reaches a sink."""
    roles = {"source": source, "sink": sink, "sanitizer": sanitizer}
    # A role that the whole text does not have is looked for on no line.
    rows = let(
        F.struct(*[_found(text, regex).alias(name) for name, regex in roles.items()]),
        lambda has: F.transform(lines(text), lambda raw, i: _line(raw, i, roles, has)),
    )

    def with_rows(rows: Column) -> Column:
        none = F.array().cast(_FUNCTIONS)
        by_indent = lang.isin("python", "ruby")
        indented = F.when(
            (by_indent | (lang == "generic")) & F.contains(text, F.lit("def")),
            _indented_functions(rows),
        )
        braced = F.when(~by_indent & F.contains(text, F.lit("{")), _braced_functions(rows))
        fns = F.concat(F.coalesce(indented, none), F.coalesce(braced, none))
        return let(fns, lambda fns: _hits(rows, fns))

    return F.sort_array(F.array_distinct(let(rows, with_rows)))
