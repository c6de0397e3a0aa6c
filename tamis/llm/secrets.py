"""Secret scans through a trigram index, with DataFrame functions only.

Every rule is a regular expression. From it follows a Boolean query over
trigrams that each match contains; the index holds postings (trigram, document)
for the trigrams that some rule asks for. Postings are intersected and united
per document, the documents that satisfy a rule's query are verified by its
expression, and rules without mandatory trigrams are run on all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STRINGS = 64  # alternatives followed while deriving a query
MASK_BITS = 62
_STEP = 256


@dataclass(frozen=True)
class SecretRule:
    """A match counts if its ``group`` has ``least`` characters; others are dropped after matching."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    SecretRule(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=6,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", "[0-9a-f]+", least=24),
)
# A key goes with its body and END line. Without one, armour headers and runs of
# base64 go, with line breaks (escaped ones too) and the word a last one leads to.
# Loops over groups give nothing back ("*+"): Java runs these without recursion.
_LABEL = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_RUN = "[ \\t\\r\\n\\\\]+[A-Za-z0-9+/=]{20,}[A-Za-z0-9+/=\\r\\n\\\\]*"
PRIVATE_KEY = (
    f"-----BEGIN {_LABEL}(?:[^-]*(?:-{{1,4}}[^-]+)*+-----END {_LABEL}"
    "|(?:[ \\t\\r\\n]+[A-Za-z][A-Za-z-]*: [^\\n]*)*+" + f"(?:{_RUN})*+)"
)
RULES = (
    *BASE_RULES,
    SecretRule("private_key", PRIVATE_KEY),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
)

Query = tuple | str | None  # ("and" | "or", parts), a trigram, or None: anything


def _all(parts: list[Query]) -> Query:
    kept = sorted({p for p in parts if p is not None}, key=repr)
    return ("and", tuple(kept)) if len(kept) > 1 else kept[0] if kept else None


def _any(parts: list[Query]) -> Query:
    if not parts or None in parts:
        return None
    kept = sorted(set(parts), key=repr)
    return ("or", tuple(kept)) if len(kept) > 1 else kept[0]


def _of_strings(strings: set[str]) -> Query:
    """A text has one of the strings, so it has all trigrams of one of them."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(regex: str) -> Query:
    """The query that the lower-cased text of every match satisfies, or None.

    A part of the expression is either a small set of strings, which is carried
    on to its neighbours, or it has a query of its own."""

    def sequence(items) -> tuple[set[str] | None, Query]:
        carried, found, exact = {""}, [], True
        for item in items:
            strings, query = one(item)
            if strings is not None and len(carried) * len(strings) <= MAX_STRINGS:
                carried = {a + b for a in carried for b in strings}
                continue
            found += [_of_strings(carried), query if strings is None else None]
            carried, exact = (strings if strings is not None else {""}), False
        return (carried, None) if exact else (None, _all([*found, _of_strings(carried)]))

    def one(item) -> tuple[set[str] | None, Query]:
        kind, value = item
        if kind is op.LITERAL:
            return {chr(value).lower()}, None
        if kind is op.IN:
            chars = set()
            for k, v in value:
                if k is op.LITERAL:
                    chars.add(chr(v).lower())
                elif k is op.RANGE and v[1] - v[0] < MAX_STRINGS:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 8 else (None, None)
        if kind is op.SUBPATTERN:
            return sequence(value[3])
        if kind is op.BRANCH:
            parts = [sequence(x) for x in value[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MAX_STRINGS:
                return set().union(*(s for s, _ in parts)), None
            return None, _any([q if s is None else _of_strings(s) for s, q in parts])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, query = sequence(inner)
            if strings is not None and most == 1:
                return strings | ({""} if least == 0 else set()), None
            if strings is not None and least == most and len(strings) ** least <= MAX_STRINGS:
                return sequence(list(inner) * least)
            return None, (query if strings is None else _of_strings(strings)) if least else None
        if kind is op.AT:
            return {""}, None
        return None, None

    strings, query = sequence(_parser.parse(regex))
    return query if strings is None else _of_strings(strings)


def trigrams(query: Query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} if query else set()
    return set().union(*map(trigrams, query[1]))


def postings(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(trigram, doc_id): the ordinals of the vocabulary's trigrams in each text."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(
        F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)))
    )
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: Sequence[Query], vocabulary: Sequence[str]) -> DataFrame:
    """(doc_id, rules): documents whose postings satisfy queries, with the
    ordinals of these."""
    place = {t: i for i, t in enumerate(vocabulary)}
    words = range(-(-len(vocabulary) // MASK_BITS))
    bit = F.expr(f"shiftleft(1L, trigram % {MASK_BITS})")
    masks = index.groupBy("doc_id").agg(
        *(F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == w, bit)).alias(f"m{w}") for w in words)
    )

    def holds(query: Query) -> Column:
        if isinstance(query, str):
            at = place[query]
            return F.coalesce(F.col(f"m{at // MASK_BITS}"), F.lit(0)).bitwiseAND(F.lit(1 << at % MASK_BITS)) != 0
        out = None
        for part in map(holds, query[1]):
            out = part if out is None else (out & part if query[0] == "and" else out | part)
        return out

    found = F.array_compact(F.array(*(F.when(holds(q), F.lit(i)) for i, q in enumerate(queries) if q is not None)))
    return masks.select("doc_id", found.alias("rules")).where(F.size("rules") > 0)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sums (or what ``step`` makes of two) of all prefixes from zero, in steps
    so that no long array is copied per element."""
    empty = F.array().cast("array<int>")

    def fold(array: Column, start: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(start.cast("int").alias("total"), empty.alias("seen")),
            lambda acc, x: F.struct(
                step(acc["total"], x).alias("total"), F.array_append(acc["seen"], step(acc["total"], x)).alias("seen")
            ),
            lambda acc: acc["seen"],
        )

    return F.aggregate(
        _parts(values),
        F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("seen")),
        lambda acc, part: F.struct(
            step(acc["total"], F.aggregate(part, F.lit(0), step)).alias("total"),
            F.array_append(acc["seen"], fold(part, acc["total"])).alias("seen"),
        ),
        lambda acc: F.flatten(acc["seen"]),
    )


def _parts(values: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")),
        lambda i: F.slice(values, i * _STEP + 1, _STEP),
    )


def _spans(n: int, rule: SecretRule) -> Column:
    """Of the pieces between matches, the matches and the deciding groups: (start, order, end)."""
    before, size, kept = F.col(f"__before{n}"), F.col(f"__size{n}"), F.col(f"__kept{n}")
    both = F.zip_with(before, size, lambda b, s: F.coalesce(b, F.lit(0)) + F.coalesce(s, F.lit(0)))
    ends = _running(both, lambda a, b: a + b)
    spans = F.zip_with(
        F.slice(ends, 1, F.size(size)),
        F.zip_with(size, kept, lambda s, k: F.struct(s.alias("s"), k.alias("k"))),
        lambda end, x: F.when(
            x["k"] >= rule.least, F.struct((end - x["s"]).alias("start"), F.lit(n).alias("order"), end.alias("end"))
        ),
    )
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    return F.when(F.size(size) > 0, F.array_compact(spans)).otherwise(none)


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """``docs`` with secrets: array<struct<kind, start, end>> by start, then by
    the order of rules; positions are code points, the end is exclusive.

    Matches of one rule do not overlap, those of different rules may. Null text
    has no secrets; rows of a repeated or null doc_id are verified each by its
    own text; a column of the name ``secrets`` is replaced."""
    queries = [trigram_query(r.regex) for r in rules]
    vocabulary = sorted(set().union(*map(trigrams, queries)))
    docs = docs.drop("secrets")
    columns = docs.columns
    if vocabulary:
        found = candidates(postings(docs, vocabulary), queries, vocabulary)
        found = found.select(F.col("doc_id").alias("__doc"), F.col("rules").alias("__rules")).hint("shuffle_hash")
        docs = docs.join(found, docs["doc_id"].eqNullSafe(found["__doc"]), "left")
    else:
        docs = docs.withColumn("__rules", F.array().cast("array<int>"))
    parts, none = {}, F.array().cast("array<int>")
    for n, (rule, query) in enumerate(zip(rules, queries)):
        applies = F.col("text").isNotNull() & (
            F.lit(True) if query is None else F.coalesce(F.array_contains("__rules", n), F.lit(False))
        )
        if query is None:  # one look without captures spares most texts the rest
            one_class = not rule.group and re.fullmatch(r"\[[^\[\]\\]*\]\+", rule.regex)
            applies = applies & F.col("text").rlike(f"{rule.regex[:-1]}{{{rule.least},}}" if one_class else rule.regex)
        regex = F.lit(rule.regex)
        for name, value in (
            ("before", F.split("text", rule.regex, -1)),
            ("size", F.regexp_extract_all("text", regex, F.lit(0))),
            ("kept", F.regexp_extract_all("text", regex, F.lit(rule.group))),
        ):
            parts[f"__{name}{n}"] = F.when(applies, F.transform(value, F.length)).otherwise(none)
    docs = docs.select(*columns, *(v.alias(k) for k, v in parts.items()))
    spans = F.array_sort(F.concat(*(_spans(n, rule) for n, rule in enumerate(rules))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    secrets = F.transform(
        spans, lambda x: F.struct(F.get(kinds, x["order"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return docs.select(*columns, secrets.alias("secrets"))


def redact(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """``docs`` with every secret in text replaced by its kind in brackets; a
    column n_chars is counted anew. Texts without secrets stay as they are.

    The spans of all rules are cut from the original text. Those that overlap
    are one, of the kind of the first."""
    columns = [c for c in docs.columns if c != "secrets"]
    has = F.size("secrets") > 0
    reach = _running(F.transform("secrets", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    clean = scan_secrets(docs, rules).withColumn("__reach", F.when(has, reach))
    # a cut starts where no span before reaches; the text kept before it starts where the last cut ended
    ended = F.concat(F.array(F.lit(0)), F.col("__reach"))
    cuts = F.zip_with(
        "secrets", F.slice(ended, 1, F.size("secrets")), lambda x, e: F.struct(x["kind"], x["start"], e.alias("from"))
    )
    clean = clean.withColumn("__cuts", F.when(has, F.filter(cuts, lambda x: x["start"] >= x["from"])))
    # in parts, as a substring is sought from the start of its text
    parts = F.transform(
        _parts(F.col("__cuts")),
        lambda p: F.struct(
            p.alias("cuts"),
            p[0]["from"].alias("at"),
            F.col("text").substr(p[0]["from"] + 1, F.element_at(p, -1)["start"] - p[0]["from"]).alias("text"),
        ),
    )
    shown = F.transform(
        parts,
        lambda p: F.array_join(
            F.transform(
                p["cuts"],
                lambda x: F.concat(
                    p["text"].substr(x["from"] - p["at"] + 1, x["start"] - x["from"]), F.lit("["), x["kind"], F.lit("]")
                ),
            ),
            "",
        ),
    )
    rest = F.col("text").substr(F.element_at("__reach", -1) + 1, F.length("text"))
    clean = clean.withColumn("text", F.when(has, F.concat(F.array_join(shown, ""), rest)).otherwise(F.col("text")))
    clean = clean.select(*columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else clean


def digest(scanned: DataFrame, base: Sequence[SecretRule] = BASE_RULES) -> DataFrame:
    """doc_id, a count and a checksum of the base rules' spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint")

    secrets = F.col("secrets")
    own = F.filter(secrets, lambda x: x["kind"].isin([r.kind for r in base]))
    return scanned.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in base),
        F.sha2(listed(own), 256).alias("base_sha256"),
        listed(secrets).alias("spans"),
    )
