"""The rule pattern language, turned into regular expressions on the driver.

A pattern is text in which

* a run of white space stands for optional white space,
* ``$NAME`` captures one or more characters, across lines if need be,
* ``$...NAME`` captures zero or more, ``...`` skips zero or more,
* ``\\$`` is a dollar sign.

Every other character stands for itself. A capture at the very end of the
pattern is greedy, all others are lazy.

The regular expressions built here find the same matches as the plain
translation but in linear time. Two facts allow that:

* Once the text after a gap has been found at its first place, looking for it
  further right cannot help the remaining parts, so that step may be atomic.
  White space that touches the next gap stays outside the atomic group, for
  it may have to give characters back.
* If the rest of a pattern cannot be matched after one occurrence of its
  head, it cannot be matched after a later one either. So the way to the head
  is an atomic lazy skip anchored at the end of the previous match (``\\G``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tamis.functions.text import UNICODE, WS

_TOKEN = re.compile(
    rf"(?P<ws>{WS}+)|(?P<dollar>\\\$)|\$\.\.\.(?P<rest>[A-Za-z0-9_]*)"
    r"|\$(?P<var>[A-Za-z0-9_]+)|(?P<skip>\.\.\.)|(?P<char>.)",
    re.S,
)
_WORD = re.compile(r"[^\w.\-]+")


class PatternError(ValueError):
    """The pattern cannot be compiled."""


@dataclass(frozen=True)
class Gap:
    name: str | None
    least: int
    greedy: bool

    def regex(self, capture: bool) -> str:
        body = "." + ("+" if self.least else "*") + ("" if self.greedy else "?")
        if self.name is None:
            return body
        return f"({body})" if capture else body


@dataclass(frozen=True)
class Piece:
    """Literal text between two gaps."""

    lead: str
    core: str
    trail: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class CompiledPattern:
    """``search`` has the groups (skipped text, head, rest); ``core`` is
    anchored and has one group per capture, in the order of ``names``;
    ``words`` are literal strings each match contains."""

    names: tuple[str, ...]
    search: str
    core: str
    words: tuple[str, ...]

    @property
    def is_literal(self) -> bool:
        """Whether the matches are just the occurrences of one word."""
        return len(self.words) == 1 and self.search == f"(?s)()({re.escape(self.words[0])})()"


def _piece(tokens: list[tuple[str, str]]) -> Piece:
    blank = WS + "*"
    lead = blank if tokens and tokens[0][0] == "ws" else ""
    trail = blank if len(tokens) > 1 and tokens[-1][0] == "ws" else ""
    inner = tokens[bool(lead) : len(tokens) - bool(trail)]
    core = "".join(blank if kind == "ws" else re.escape(text) for kind, text in inner)
    raw = "".join("\n" if kind == "ws" else text for kind, text in inner)
    return Piece(lead, core, trail, tuple(w for w in raw.split("\n") if w))


def split_pattern(pattern: str) -> tuple[list[Piece], list[Gap]]:
    """Literal pieces and the gaps between them (one gap less than pieces)."""
    run: list[tuple[str, str]] = []
    pieces: list[Piece] = []
    gaps: list[Gap] = []
    for m in _TOKEN.finditer(pattern):
        kind = m.lastgroup
        at_end = m.end() == len(pattern)
        if kind == "ws":
            run.append(("ws", ""))
        elif kind == "dollar":
            run.append(("text", "$"))
        elif kind == "char":
            run.append(("text", m.group()))
        else:
            if kind == "rest":
                clean = m["rest"].replace("_", "")
                gap = Gap(f"{clean}_REST" if clean else "REST", 0, at_end)
            elif kind == "var":
                gap = Gap(m["var"], 1, at_end)
            else:
                gap = Gap(None, 0, False)
            pieces.append(_piece(run))
            gaps.append(gap)
            run = []
    pieces.append(_piece(run))
    return pieces, gaps


def compile_pattern(pattern: str) -> CompiledPattern:
    pieces, gaps = split_pattern(pattern)
    names = tuple(g.name for g in gaps if g.name)
    if len(set(names)) != len(names):
        raise PatternError(f"metavariable used twice in {pattern!r}")
    if any(n[0].isdigit() for n in names):
        raise PatternError(f"metavariable name starts with a digit in {pattern!r}")
    words = tuple(w for p in pieces for w in p.words)
    if not words and not any(g.least for g in gaps):
        raise PatternError(f"pattern {pattern!r} also matches empty text")

    def tail(capture: bool) -> str:
        out = pieces[0].trail
        for gap, piece in zip(gaps, pieces[1:]):
            step = gap.regex(capture) + piece.lead
            out += f"(?>{step}{piece.core}){piece.trail}" if piece.core else step
        return out

    head = pieces[0].lead + pieces[0].core
    if not gaps:
        search = f"()({head})({tail(False)})"
    elif pieces[0].core:
        search = f"\\G(?>(.*?)({head}))({tail(False)})"
    else:
        search = f"\\G()()({head}{tail(False)})"
    flags = "(?s)" + (UNICODE if WS in search else "")
    return CompiledPattern(names, flags + search, f"{flags}^{head}{tail(True)}", words)


def index_literals(pattern: str) -> list[str]:
    """Lower-case literals of three or more bytes for candidate look-up:
    every dotted or dashed name as a whole, and its parts."""
    pieces, _ = split_pattern(pattern)
    out: list[str] = []
    for word in (w for p in pieces for w in p.words):
        for token in _WORD.split(word):
            for lit in (*re.split(r"[.\-]", token), *token.split("."), token):
                if len(lit.encode()) >= 3 and lit.lower() not in out:
                    out.append(lit.lower())
    return out


def flow_regex(pattern: str) -> tuple[str, tuple[str, ...]]:
    """Regex and literal words of a source, sink or sanitizer pattern. Here
    ``$NAME`` swallows dots too, and white space stands for itself."""
    parts = re.split(r"\$[A-Za-z0-9_.]*|\.\.\.", pattern)
    return ".*?".join(re.escape(p) for p in parts), tuple(p for p in parts if p)


# The ASCII classes of the constraint language.
POSIX_CLASSES = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": "\\x00-\\x7F", "blank": "\\t ",
    "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": "!-/:-@\\[-`{-~", "space": "\\t-\\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_SYNTAX = re.compile(
    r"\\u\{(?P<code>[0-9a-fA-F]+)\}|\\.|\[:(?P<not>\^?)(?P<posix>[a-z]+):\]|\(\?P?<(?P<group>[A-Za-z_]\w*)>"
    r"|\{,(?P<most>\d+)\}|(?P<open>\[\^?\]?)|(?P<close>\])|(?P<end>\$)|.",
    re.S,
)


def java_regex(regex: str) -> str:
    """A constraint's regex in the syntax of the JVM, with Unicode classes.

    The constraint language has POSIX classes, \\u{...}, named groups (of which
    only the grouping matters here), {,n}, and $ for the very end unless (?m) is
    set. Whether the result is valid is for the JVM to say."""
    depth, out = 0, []
    multiline = re.search(r"\(\?[a-zA-Z]*m", regex)

    for m in _SYNTAX.finditer(regex):
        part = m[0]
        if m["code"]:
            part = f"\\x{{{m['code']}}}"
        elif m["posix"] in POSIX_CLASSES and depth:
            part = f"[{m['not']}{POSIX_CLASSES[m['posix']]}]"
        elif m["open"]:
            # a bracket right behind the opening one stands for itself
            part = "[" + part[1:].replace("]", "\\]")
            depth += 1
        elif m["close"] and depth:
            depth -= 1
        elif m["group"] and not depth:
            part = "(?:"
        elif m["most"] and not depth:
            part = f"{{0,{m['most']}}}"
        elif m["end"] and not depth and not multiline:
            part = r"\z"
        out.append(part)
    return "(?U)" + "".join(out)
