"""Rules against files: candidate look-up, matching, constraints.

The unit of work is a row that holds one file and one pattern. Everything up to
the findings is a narrow transformation: the text is never shuffled, a file
that no pattern can match costs one literal look-up, and a hot source or a
group of copies needs no special care because no key is grouped on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.patterns import (
    PatternError,
    compile_pattern,
    flow_regex,
    index_literals,
    java_regex,
)
from tamis.functions.text import let, lines, running_sum, trim_ws
from tamis.operators.flow import flow_lines
from tamis.operators.literals import literal_tests, ordinals
from tamis.sources.rules import Flow, Rule, RuleSet
from tamis.sources.small import small_table

# A Unicode noncharacter that marks where matches start. A text that holds it
# gets a longer marker of its own.
MARK = "﷐"
# The compiled patterns are broadcast; their size is known on the driver.
BROADCAST_LIMIT_BYTES = 256 << 20
# Up to so many patterns, and words of a pattern, are tested by name: generated
# code grows with them, where lambdas do not.
INLINE = 8

PATTERN_FIELDS = {
    "pat_ord": "int",
    "rule_ord": "int",
    "rule_id": "string",
    "languages": "array<string>",
    "kind": "string",
    "search": "string",
    "core": "string",
    "names": "array<string>",
    "words": "array<string>",
    "literal": "string",
    "inside": "string",
    "never": "string",
    "never_word": "string",
    "constraints": "array<struct<name:string,regex:string>>",
    "comparison": "struct<name:string,op:string,number:double>",
    "source": "string",
    "sink": "string",
    "sanitizer": "string",
}
RULE_FIELDS = {
    "rule_ord": "int",
    "rule_id": "string",
    "languages": "array<string>",
    "severity": "string",
    "category": "string",
    "message": "string",
    "fix": "string",
    "metadata": "map<string,string>",
}


def _fields(kinds: dict[str, str]) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in kinds.items())


class CompiledRules:
    """Patterns ready for Spark, and what went wrong while compiling them."""

    def __init__(self, rule_set: RuleSet | list[Rule]):
        self.rules = rule_set.rules if isinstance(rule_set, RuleSet) else list(rule_set)
        self.warnings = list(getattr(rule_set, "warnings", []))
        self.rows: list[dict] = []
        # Per pattern the literal that decides whether it can match at all;
        # None when there is none.
        self.anchors: list[tuple[str, ...] | None] = []
        self._checked = False
        for rule_ord, rule in enumerate(self.rules):
            self._add(rule_ord, rule)

    def _warn(self, rule: Rule, error: Exception) -> None:
        self.warnings.append(f"rule {rule.id}: {error}; pattern skipped")

    def _compiled(self, rule: Rule, pattern: str | None):
        if pattern is None:
            return None
        try:
            return compile_pattern(pattern)
        except PatternError as e:
            self._warn(rule, e)
            return None

    def _constraints(self, rule: Rule) -> list[dict]:
        return [{"name": n, "regex": java_regex(r)} for n, r in rule.metavariable_regex.items()]

    def _check_constraints(self, spark: SparkSession) -> None:
        """Only the engine that runs them knows which regexes are valid. A rule
        with one that is not finds nothing, and the others are not affected."""
        if self._checked:
            return
        self._checked = True
        compiler = spark._jvm.java.util.regex.Pattern
        bad: dict[str, str] = {}
        for row in self.rows:
            for c in row.get("constraints") or []:
                try:
                    compiler.compile(c["regex"])
                except (Py4JJavaError, IllegalArgumentException) as e:
                    bad[row["rule_id"]] = f"unusable constraint on {c['name']}: {str(e).splitlines()[0]}"
                    c["regex"] = None
        self.warnings += [f"rule {rid}: {why}; it finds nothing" for rid, why in bad.items()]

    def _add(self, rule_ord: int, rule: Rule) -> None:
        inside = self._compiled(rule, rule.pattern_inside)
        if rule.pattern_inside is not None and inside is None:
            return  # an unusable scope holds nothing
        row = {
            "rule_ord": rule_ord,
            "rule_id": rule.id,
            "languages": list(rule.languages),
            "inside": inside.search if inside else None,
        }
        if rule.flow:
            self._add_flow(row, rule.flow)
            return
        never = self._compiled(rule, rule.pattern_not)
        row |= {
            "kind": "pattern",
            "never": never.search if never else None,
            "never_word": never.words[0] if never and never.is_literal else None,
            "constraints": self._constraints(rule),
            "comparison": parse_comparison(rule.metavariable_comparison),
        }
        for pattern in rule.patterns:
            c = self._compiled(rule, pattern)
            if c is not None:
                anchor = (max(c.words, key=len),) if c.words else None
                found = {
                    "search": c.search,
                    "core": c.core,
                    "names": list(c.names),
                    "words": sorted(set(c.words)),
                    "literal": c.words[0] if c.is_literal else None,
                }
                self._append(row | found, anchor)

    def _add_flow(self, row: dict, flow: Flow) -> None:
        if not flow.sinks:
            return  # no sink, no finding

        def either(patterns: tuple[str, ...]) -> str | None:
            regexes = [f"(?:{flow_regex(p)[0]})" for p in patterns]
            return "(?s)" + "|".join(regexes) if regexes else None

        words = [flow_regex(p)[1] for p in flow.sinks]
        anchor = tuple(max(w, key=len) for w in words) if all(words) else None
        roles = {
            "source": either(flow.sources),
            "sink": either(flow.sinks),
            "sanitizer": either(flow.sanitizers),
        }
        self._append(row | {"kind": "flow"} | roles, anchor)

    def _append(self, row: dict, anchor: tuple[str, ...] | None) -> None:
        self.rows.append({"pat_ord": len(self.rows)} | row)
        self.anchors.append(anchor)

    @property
    def size_bytes(self) -> int:
        return sum(len(repr(r)) for r in self.rows)

    @property
    def needs_captures(self) -> bool:
        return any(r.metavariable_regex or r.metavariable_comparison for r in self.rules)

    def pattern_table(self, spark: SparkSession) -> DataFrame:
        self._check_constraints(spark)
        return small_table(spark, self.rows, _fields(PATTERN_FIELDS))

    def rule_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"rule_ord": i, "rule_id": r.id}
            | {n: getattr(r, n) for n in RULE_FIELDS if n not in ("rule_ord", "rule_id")}
            for i, r in enumerate(self.rules)
        ]
        return small_table(spark, rows, _fields(RULE_FIELDS))

    def small(self, table: DataFrame) -> DataFrame:
        """Broadcast a table of rules or patterns while its size allows."""
        return F.broadcast(table) if self.size_bytes <= BROADCAST_LIMIT_BYTES else table


def compile_rules(rules: RuleSet | list[Rule] | CompiledRules) -> CompiledRules:
    return rules if isinstance(rules, CompiledRules) else CompiledRules(rules)


def parse_comparison(text: str | None) -> dict | None:
    """``$NAME op number``; anything else can never hold."""
    if text is None:
        return None
    try:
        name, op, number = text.split()
        return {"name": name.lstrip("$"), "op": op, "number": float(number)}
    except ValueError:
        return {"name": "", "op": "never", "number": 0.0}


# -- candidates --------------------------------------------------------------


def candidate_ordinals(compiled: CompiledRules, text: Column, lang: Column) -> Column:
    """Ordinals of the patterns that apply to the language and whose rarest
    literal occurs in the text, ascending."""
    found = ordinals(text, compiled.anchors)
    if all("generic" in row["languages"] for row in compiled.rows):
        return found
    # by language, what applies to it; "" stands for all that no rule names
    named = {x for row in compiled.rows for x in row["languages"]} - {"generic"}
    applies = {x: [x in row["languages"] or "generic" in row["languages"] for row in compiled.rows] for x in ("", *named)}
    table = F.from_json(F.lit(json.dumps(applies)), "map<string,array<boolean>>")
    own = F.when(lang.isin(*named), F.try_element_at(table, lang)).otherwise(table[""])
    return let(own, lambda flags: F.filter(found, lambda i: F.get(flags, i)))


def candidate_rules(files: DataFrame, rules: RuleSet | list[Rule]) -> DataFrame:
    """(path, rule_ord, rule_id) for every rule with an index literal in the
    lower-cased text, and for every rule that has no such literal."""
    rules = rules.rules if isinstance(rules, RuleSet) else rules
    spark = files.sparkSession
    entries = []
    for i, r in enumerate(rules):
        lits = [x for p in r.positive_patterns() for x in index_literals(p)]
        entries.append((i, r.id, list(dict.fromkeys(lits))))
    ords = ordinals(F.lower("text"), [lits or None for _, _, lits in entries])
    names = small_table(
        spark, [{"rule_ord": i, "rule_id": r} for i, r, _ in entries], "rule_ord:int,rule_id:string"
    )
    return (
        files.select("path", F.explode(ords).alias("rule_ord"))
        .join(names, "rule_ord")
        .select("path", "rule_ord", "rule_id")
    )


def candidate_pairs(files: DataFrame, compiled: CompiledRules) -> DataFrame:
    """Each file once per pattern that may match it."""
    patterns = compiled.small(compiled.pattern_table(files.sparkSession))
    if 0 < len(compiled.rows) <= INLINE:
        ords = F.array(*_inline_tests(compiled, F.col("text"), F.col("lang")))
        pairs = files.withColumn("pat_ord", F.explode(ords)).filter("pat_ord is not null")
    else:
        ords = candidate_ordinals(compiled, F.col("text"), F.col("lang"))
        pairs = files.withColumn("pat_ord", F.explode(ords))
    return pairs.join(patterns, "pat_ord")


def _inline_tests(compiled: CompiledRules, text: Column, lang: Column) -> list[Column]:
    """``candidate_ordinals`` of few patterns without a lambda: the ordinal or null."""
    tests = []
    for i, (row, hit) in enumerate(zip(compiled.rows, literal_tests(text, compiled.anchors))):
        if "generic" not in row["languages"]:
            hit = hit & lang.isin(*row["languages"])
        tests.append(F.when(hit, F.lit(i)))
    return tests


# -- matching ----------------------------------------------------------------


def _mark_of(text: Column) -> Column:
    # never null, which spares a filter on it below whatever makes the text
    own = F.when(F.contains(text, F.lit(MARK)), F.concat(F.lit(MARK), F.md5(text)))
    return F.coalesce(own, F.lit(MARK))


def _marked(text: Column, search: Column, mark: Column) -> Column:
    """The text with a marker in front of every match."""
    return F.regexp_replace(text, search, F.concat(F.lit("$1"), mark, F.lit("$2$3")))


def _marked_lines(marked: Column, mark: Column) -> Column:
    """(line, t) of the lines that hold a marker."""
    numbered = F.transform(
        F.split(marked, "\n", -1),
        lambda l, i: F.when(
            F.contains(l, mark), F.struct((i + 1).alias("line"), l.alias("t"))
        ),
    )
    return F.array_compact(numbered)


def _snippet(x: Column, mark: Column) -> Column:
    return trim_ws(F.replace(x["t"], mark, F.lit("")))


def _start(x: Column, col: Column, snippet: Column) -> Column:
    return F.struct(
        x["line"].alias("line"), col.cast("int").alias("col"), snippet.alias("snippet")
    )


def _first_starts(marked: Column, mark: Column) -> Column:
    """(line, col, snippet) of the first match on each line. Columns count
    bytes."""

    def first(x: Column) -> Column:
        before = F.call_function("substring_index", x["t"], mark, F.lit(1))
        return _start(x, F.octet_length(before), _snippet(x, mark))

    return F.transform(_marked_lines(marked, mark), first)


def _all_starts(marked: Column, mark: Column) -> Column:
    """(line, col, snippet) of every match."""

    def on_line(x: Column) -> Column:
        def starts(snippet: Column) -> Column:
            lengths = F.transform(F.split(x["t"], mark, -1), lambda p: F.octet_length(p))
            before = lambda n: running_sum(F.slice(n, 1, F.size(n) - 1))
            cols = let(lengths, before)
            return F.transform(cols, lambda c: _start(x, c, snippet))

        return let(_snippet(x, mark), starts)

    return F.flatten(F.transform(_marked_lines(marked, mark), on_line))


def _captures(match_on: Column, core: Column, names: Column) -> Column:
    """name -> text for a string that begins with a match."""
    values = F.transform(
        names, lambda n, i: F.call_function("regexp_extract", match_on, core, i + 1)
    )
    return F.map_from_arrays(names, values)


def _holds(captures: Column, constraints: Column, comparison: Column) -> Column:
    regexes = F.forall(
        constraints,
        lambda c: F.coalesce(
            # An unbound name is no violation, an unusable regex is.
            F.element_at(captures, c["name"]).isNull()
            | (F.regexp_instr(F.element_at(captures, c["name"]), c["regex"]) > 0),
            F.lit(False),
        ),
    )
    raw = F.element_at(captures, comparison["name"])
    number = F.regexp_extract(raw, r"(?U)(-?\d+(\.\d+)?)", 1).try_cast("double")
    op, other = comparison["op"], comparison["number"]
    near = F.abs(number - other) < F.lit(2.220446049250313e-16)
    test = (
        F.when(op == ">", number > other)
        .when(op == ">=", number >= other)
        .when(op == "<", number < other)
        .when(op == "<=", number <= other)
        .when(op.isin("==", "="), near)
        .when(op == "!=", ~near)
        .otherwise(False)
    )
    compares = comparison.isNull() | (
        (op != "never") & (raw.isNull() | number.isNull() | test)
    )
    return regexes & F.coalesce(compares, F.lit(False))


_HIT = "struct<line:int,col:int,snippet:string,captures:map<string,string>>"


def _hit(line: Column, col: Column, snippet: Column, captures: Column | None = None) -> Column:
    captures = F.lit(None) if captures is None else captures
    return F.struct(
        line.alias("line"),
        col.alias("col"),
        snippet.alias("snippet"),
        captures.alias("captures"),
    ).cast(_HIT)


def _checked_hits(marked: Column, mark: Column) -> Column:
    """Every match with its captures, constraints applied. Split at the
    markers, the n-th part begins with the n-th match."""
    parts = F.split(marked, mark, -1)
    zipped = F.zip_with(
        _all_starts(marked, mark),
        F.slice(parts, 2, F.size(parts) - 1),
        lambda s, part: _hit(
            s["line"], s["col"], s["snippet"], _captures(part, F.col("core"), F.col("names"))
        ),
    )
    return F.filter(
        zipped, lambda h: _holds(h["captures"], F.col("constraints"), F.col("comparison"))
    )


def _pattern_hits(needs: Needs) -> Column:
    """Hits of a pattern row; parts of the expression that no rule of the set
    needs are left out."""
    text, mark, marked = F.col("text"), F.col("_mark"), F.col("_marked")
    starts = _all_starts if needs.every else _first_starts
    found = F.transform(
        starts(marked, mark), lambda s: _hit(s["line"], s["col"], s["snippet"])
    )
    if needs.captures:
        found = _checked_hits(marked, mark)
    elif needs.constraints:
        constrained = (F.size("constraints") > 0) | F.col("comparison").isNotNull()
        found = F.when(constrained, _checked_hits(marked, mark)).otherwise(found)
    if needs.never:
        excluded = F.transform(
            _marked_lines(_marked(text, F.col("never"), mark), mark), lambda x: x["line"]
        )
        excluded = F.when(F.col("never").isNotNull(), excluded).otherwise(
            F.array().cast("array<int>")
        )
        found = let(
            excluded, lambda ns: F.filter(found, lambda h: ~F.array_contains(ns, h["line"]))
        )
    return F.when(F.contains(marked, mark), found)


def _flow_hits() -> Column:
    text = F.col("text")
    at = flow_lines(text, F.col("lang"), F.col("source"), F.col("sink"), F.col("sanitizer"))
    return let(
        lines(text),
        lambda ls: F.transform(
            at,
            lambda n: _hit(n, F.lit(0), F.element_at(ls, n)),
        ),
    )


@dataclass(frozen=True)
class Needs:
    """Which parts of the match expression a set of rules uses."""

    every: bool
    captures: bool
    constraints: bool
    never: bool
    inside: bool
    patterns: bool
    flows: bool
    scope_flows: bool
    never_regex: bool
    words: int

    @property
    def by_line(self) -> bool:
        """Whether a line that holds a marker is a finding, whatever else it holds."""
        special = self.every or self.captures or self.constraints or self.never_regex or self.flows
        return self.patterns and not special and self.words <= INLINE


@lru_cache(maxsize=64)
def _match_columns(needs: Needs) -> tuple[Column, Column, Column]:
    """(marker, marked text, hits). They only depend on which parts are used,
    and making them is many calls into the JVM, so they are kept."""
    text, is_flow = F.col("text"), F.col("kind") == "flow"
    in_scope = F.lit(True)
    if needs.inside:
        in_scope = F.col("inside").isNull() | (F.regexp_instr(text, F.col("inside")) > 0)
    # Literal tests first: the regex only runs where all words are present.
    has_words = F.forall(F.col("words"), lambda w: F.contains(text, w))
    marked = F.when(
        ~is_flow & has_words & in_scope, _marked(text, F.col("search"), F.col("_mark"))
    )
    hits = _pattern_hits(needs) if needs.patterns else None
    if needs.flows:
        # Nothing flows in a text without a sink, or with neither a source nor a
        # function whose parameters may be one; folding is for the others.
        starts = F.coalesce(F.regexp_instr(text, F.col("source")) > 0, F.lit(False))
        functions = F.contains(text, F.lit("def")) | F.contains(text, F.lit("{"))
        flows = is_flow & (F.regexp_instr(text, F.col("sink")) > 0) & (functions | starts)
        flow = F.when(flows & in_scope if needs.scope_flows else flows, _flow_hits())
        hits = flow if hits is None else flow.otherwise(hits)
    return _mark_of(text), marked, hits


def _needs(compiled: CompiledRules, every_match: bool, captures: bool, scope_flows: bool) -> Needs:
    rules = compiled.rules
    return Needs(
        every=every_match or captures,
        captures=captures,
        constraints=compiled.needs_captures,
        never=any(r.pattern_not is not None for r in rules),
        inside=any(r.pattern_inside is not None for r in rules),
        patterns=not rules or any(not r.flow for r in rules),
        flows=any(r.flow for r in rules),
        scope_flows=scope_flows,
        never_regex=any(r.get("never") is not None and r["never_word"] is None for r in compiled.rows),
        words=max((len(r.get("words") or ()) for r in compiled.rows), default=0),
    )


def _kept(pairs: DataFrame) -> list[str]:
    """The columns of ``pairs`` without the text and the pattern."""
    drop = set(PATTERN_FIELDS) - {"pat_ord", "rule_ord", "rule_id"}
    return [c for c in pairs.columns if c not in drop | {"text"}]


def evaluate_pairs(
    pairs: DataFrame,
    compiled: CompiledRules,
    *,
    every_match: bool = False,
    captures: bool = False,
    scope_flows: bool = True,
) -> DataFrame:
    """Hits of (file, pattern) rows: the columns of ``pairs`` without the text
    and the pattern, plus match_ord, line, col, snippet, captures.

    Findings are one per line, so only the first match on a line is reported
    unless ``every_match`` is set. ``scope_flows`` applies pattern-inside to
    flow rules as well."""
    keep = _kept(pairs)
    needs = _needs(compiled, every_match, captures, scope_flows)
    if needs.by_line:
        return _first_on_lines(pairs, keep, needs)
    mark, marked, hits = _match_columns(needs)
    rows = pairs.withColumn("_mark", mark).withColumn("_marked", marked)
    return rows.select(*keep, F.posexplode(hits).alias("match_ord", "hit")).select(
        *keep, "match_ord", "hit.*"
    )


def _first_on_lines(pairs: DataFrame, keep: list[str], needs: Needs) -> DataFrame:
    """``evaluate_pairs`` where the first match of each line is all that is asked
    for: marked lines are rows, so that generated code does what lambdas, which
    are interpreted, do elsewhere. ``match_ord`` is the place of the line."""
    text, mark, line = F.col("text"), F.col("_mark"), F.col("_line")
    may = F.lit(True)
    for i in range(needs.words):
        may = may & F.coalesce(F.contains(text, F.get("words", F.lit(i))), F.lit(True))
    if needs.inside:
        may = may & (F.col("inside").isNull() | (F.regexp_instr(text, F.col("inside")) > 0))
    marked = F.when(may, _marked(text, F.col("search"), mark))
    never = ["never_word"] if needs.never else []
    found = (
        pairs.withColumn("_mark", _mark_of(text))
        .select(*keep, "_mark", *never, F.posexplode(F.split(marked, "\n", -1)).alias("match_ord", "_line"))
        .filter(F.contains(line, mark))
        .withColumn("_plain", F.replace(line, mark, F.lit("")))
    )
    if needs.never:
        # a word holds no line end: it occurs on a line or does not
        found = found.filter(F.col("never_word").isNull() | ~F.contains("_plain", F.col("never_word")))
    return found.select(
        *keep,
        "match_ord",
        (F.col("match_ord") + 1).alias("line"),
        F.octet_length(F.call_function("substring_index", line, mark, F.lit(1))).alias("col"),
        trim_ws(F.col("_plain")).alias("snippet"),
        F.lit(None).cast("map<string,string>").alias("captures"),
    )


def find_matches(files: DataFrame, rules, *, captures: bool = True) -> DataFrame:
    """Every match of every rule: no de-duplication, no suppression."""
    compiled = compile_rules(rules)
    return evaluate_pairs(
        candidate_pairs(files, compiled), compiled, every_match=True, captures=captures
    )


def count_matches(files: DataFrame, rules) -> DataFrame:
    """Number ``n`` of the matches of each (file, pattern), zeros left out:
    the rows of ``find_matches`` counted. Where no constraint, exclusion or
    flow decides, no line is cut and no match is located; a pattern that is one
    word is counted by the bytes that go when it is taken out."""
    compiled = compile_rules(rules)
    pairs = candidate_pairs(files, compiled)
    needs = _needs(compiled, True, False, True)
    mark, marked, hits = _match_columns(needs)
    rows = pairs
    if needs.constraints or needs.never or needs.flows or not needs.patterns:
        rows = pairs.withColumn("_mark", mark).withColumn("_marked", marked)
        n = F.array_size(hits)
    else:
        n = _plain_count(needs)
    return rows.select(*_kept(pairs), n.cast("bigint").alias("n")).filter("n > 0")


def _plain_count(needs: Needs) -> Column:
    text, literal = F.col("text"), F.col("literal")
    gone = F.octet_length(text) - F.octet_length(F.replace(text, literal, F.lit("")))
    has_words = F.forall(F.col("words"), lambda w: F.contains(text, w))
    n = F.when(literal.isNotNull(), gone / F.octet_length(literal)).when(
        has_words, F.regexp_count(text, F.col("search"))
    )
    if needs.inside:
        n = F.when(F.col("inside").isNull() | (F.regexp_instr(text, F.col("inside")) > 0), n)
    return n
