"""The portable rule schema, rewritten to native fields.

What a key of a rule means is one entry of a table: ``_ONE_RULE`` for the keys
of a rule, ``_RESTRICTIONS`` for those that may also stand in its AND-list. A
rule that needs something without a native counterpart is refused with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# Keys that only occur in the portable schema.
PORTABLE_KEYS = frozenset({
    "mode", "pattern-sources", "pattern-sinks", "pattern-sanitizers",
    "fix-regex", "pattern-not-inside", "pattern-regex", "pattern-propagate",
    "focus-metavariable", "requires", "equivalences",
})
# Accepted language names.
LANGUAGE_ALIASES = {
    "python": "python",
    "javascript": "javascript",
    "js": "javascript",
    "typescript": "typescript",
    "ts": "typescript",
    "tsx": "typescript",
    "go": "go",
    "golang": "go",
    "java": "java",
    "ruby": "ruby",
    "rb": "ruby",
    "php": "php",
    "csharp": "csharp",
    "c#": "csharp",
    "c": "c",
    "cpp": "cpp",
    "c++": "cpp",
    "kotlin": "kotlin",
    "scala": "scala",
    "ocaml": "ocaml",
    "bash": "bash",
    "sh": "bash",
    "shell": "bash",
    "yaml": "yaml",
    "json": "json",
    "terraform": "terraform",
    "hcl": "terraform",
    "dockerfile": "dockerfile",
    "docker": "dockerfile",
    "html": "html",
    "rust": "rust",
    "rs": "rust",
    "swift": "swift",
    "dart": "dart",
    "elixir": "elixir",
    "lua": "lua",
    "powershell": "powershell",
    "pwsh": "powershell",
    "ps1": "powershell",
    "sql": "sql",
    "generic": "generic",
}
# Severity spellings.
SEVERITY_ALIASES = {
    "ERROR": "ERROR",
    "CRITICAL": "ERROR",
    "HIGH": "ERROR",
    "WARNING": "WARNING",
    "WARN": "WARNING",
    "MEDIUM": "WARNING",
    "INFO": "INFO",
    "LOW": "INFO",
    "NOTE": "INFO",
}


class RuleSkipped(ValueError):
    """This rule cannot be expressed; the message says why."""


def _need(value, kind: type, at: str):
    """``value`` if it is of the kind. YAML has already read 010 and yes as a
    number and a truth value, so what was written is lost: not a string."""
    if isinstance(value, kind):
        return value
    if kind is str and isinstance(value, (bool, int, float)):
        raise RuleSkipped(f"{at}: put quotes around {value!r}, YAML does not read it as text")
    raise RuleSkipped(f"{at}: expected {_NAMES[kind]}, found {_NAMES.get(type(value), 'nothing')}")


_NAMES = {str: "text", list: "a list", dict: "a mapping"}


def looks_portable(doc) -> bool:
    if not isinstance(doc, dict):
        return False
    tied = any(
        "metavariable" in doc[k]
        for k in ("metavariable-regex", "metavariable-comparison")
        if isinstance(doc.get(k), dict)
    )
    listed = doc.get("patterns")
    richer = isinstance(listed, list) and not all(isinstance(x, dict) and x.keys() == {"pattern"} for x in listed)
    return tied or richer or not PORTABLE_KEYS.isdisjoint(doc)


def map_languages(names: list[str]) -> tuple[list[str], list[str]]:
    """(engine languages without repeats, names that have no counterpart)"""
    found = {n: LANGUAGE_ALIASES.get(n.lower()) for n in names}
    return list(dict.fromkeys(filter(None, found.values()))), [n for n in names if not found[n]]


def map_severity(value) -> str:
    try:
        return SEVERITY_ALIASES[_need(value, str, "severity").upper()]
    except KeyError:
        raise RuleSkipped(f"severity: {value!r} is none of {', '.join(SEVERITY_ALIASES)}") from None


def _union(value, at: str) -> Iterator[str]:
    """All patterns of a list of alternatives, however they are nested."""
    for n, x in enumerate(_need(value, list, at)):
        here = f"{at}[{n}]"
        if isinstance(x, str):
            yield x
            continue
        nested = next((k for k in ("pattern", "patterns", "pattern-either") if k in _need(x, dict, here)), None)
        if nested is None:
            raise RuleSkipped(f"{here}: no pattern among {', '.join(map(str, x)) or 'its keys'}")
        if nested == "pattern":
            yield _need(x["pattern"], str, f"{here}.pattern")
        else:
            yield from _union(x[nested], f"{here}.{nested}")


def flow_patterns(doc: dict, key: str) -> list[str]:
    return list(_union(doc.get(key, []), key))


def regex_constraints(value) -> dict[str, str]:
    """{name: regex}, from either of the two spellings."""
    given = _need(value, dict, "metavariable-regex")
    pairs = {given["metavariable"]: given.get("regex")} if "metavariable" in given else given
    return {
        _need(k, str, "metavariable-regex"): _need(v, str, f"metavariable-regex of {k}") for k, v in pairs.items()
    }


def comparison_text(value) -> str:
    given = _need(value, dict, "metavariable-comparison")
    return " ".join(_need(given.get(k), str, f"metavariable-comparison.{k}") for k in ("metavariable", "comparison"))


@dataclass
class _Draft:
    """A native rule in the making."""

    fields: dict = field(default_factory=lambda: {"metavariable_regex": {}, "metadata": {}, "fix": None})
    notes: list[str] = field(default_factory=list)

    def once(self, name: str, value, key: str) -> None:
        if name in self.fields:
            raise RuleSkipped(f"{key}: given more than once, which has no counterpart")
        self.fields[name] = value


def _languages(draft: _Draft, value, key: str) -> None:
    names = [n for n in _need(value, list, key) if isinstance(n, str)]
    known, other = map_languages(names)
    if not known:
        raise RuleSkipped(f"{key}: none of {', '.join(names) or 'these'} is known")
    if other:
        draft.notes.insert(0, f"languages left out: {', '.join(other)}")
    draft.fields["languages"] = tuple(known)


def _metadata(draft: _Draft, value, key: str) -> None:
    for name, x in (value or {}).items():
        if isinstance(x, list):
            x = ", ".join(v for v in x if isinstance(v, str)) or None
        elif isinstance(x, bool):
            x = "true" if x else "false"
        if isinstance(x, (str, int, float)):
            draft.fields["metadata"][str(name)] = str(x)
        else:
            draft.notes.append(f"{key}.{name} left out: not a plain value")


def _fix(draft: _Draft, value, key: str) -> None:
    draft.fields["fix"] = value if isinstance(value, str) else None


def _restricted(name: str) -> Callable[[_Draft, object, str], None]:
    return lambda draft, value, key: draft.once(name, _need(value, str, key), key)


# Key of a rule or of an entry of its AND-list -> what it adds.
_RESTRICTIONS: dict[str, Callable[[_Draft, object, str], None]] = {
    "pattern-not": _restricted("pattern_not"),
    "pattern-inside": _restricted("pattern_inside"),
    "metavariable-regex": lambda d, v, k: d.fields["metavariable_regex"].update(regex_constraints(v)),
    "metavariable-comparison": lambda d, v, k: d.once("metavariable_comparison", comparison_text(v), k),
}


def _and_list(draft: _Draft, value, key: str) -> None:
    positive = []
    for n, entry in enumerate(_need(value, list, key)):
        for name, x in _need(entry, dict, f"{key}[{n}]").items():
            at = f"{key}[{n}].{name}"
            if name == "pattern":
                positive.append(_need(x, str, at))
            elif name in _RESTRICTIONS:
                _RESTRICTIONS[name](draft, x, at)
            else:
                raise RuleSkipped(f"{at}: no native counterpart")
    if len(positive) != 1:
        raise RuleSkipped(f"{key}: needs one positive pattern, has {len(positive)}")
    draft.fields["patterns"] = tuple(positive)


def _either(draft: _Draft, value, key: str) -> None:
    draft.fields["patterns"] = tuple(_union(value, key))
    if not draft.fields["patterns"]:
        raise RuleSkipped(f"{key}: no alternative given")


def _single(draft: _Draft, value, key: str) -> None:
    draft.fields["patterns"] = (_need(value, str, key),)


def _text_field(draft: _Draft, value, key: str) -> None:
    draft.fields[key] = _need(value, str, key)


# The first of these that is given is the rule's positive part.
_POSITIVE: dict[str, Callable[[_Draft, object, str], None]] = {
    "pattern": _single,
    "pattern-either": _either,
    "patterns": _and_list,
}
# Keys every rule has, and keys it may have, in the order they are looked at.
_REQUIRED: dict[str, Callable[[_Draft, object, str], None]] = {
    "id": _text_field,
    "message": _text_field,
    "severity": lambda d, v, k: d.fields.update(severity=map_severity(v)),
    "languages": _languages,
}
_OPTIONAL: dict[str, Callable[[_Draft, object, str], None]] = {"metadata": _metadata, "fix": _fix}


def _flow(draft: _Draft, doc: dict) -> None:
    roles = {role: tuple(flow_patterns(doc, f"pattern-{role}")) for role in ("sources", "sinks", "sanitizers")}
    for role in ("sources", "sinks"):
        if not roles[role]:
            raise RuleSkipped(f"pattern-{role}: a flow needs at least one")
    draft.fields["flow"] = tuple(roles.values())


def translate(doc: dict) -> tuple[dict, list[str]]:
    """Native rule fields and warnings; raises RuleSkipped."""
    draft = _Draft()
    for key, add in _REQUIRED.items():
        add(draft, doc.get(key), key)
    for key, add in _OPTIONAL.items():
        if key in doc:
            add(draft, doc[key], key)
    if "fix-regex" in doc and draft.fields["fix"] is None:
        draft.notes.append("fix-regex left out: only whole fixes are known")
    if doc.get("mode") == "taint" or "pattern-sources" in doc or "pattern-sinks" in doc:
        _flow(draft, doc)
    else:
        positive = next((k for k in _POSITIVE if k in doc), None)
        if positive is None:
            raise RuleSkipped(f"nothing to look for: none of {', '.join(_POSITIVE)} is given")
        _POSITIVE[positive](draft, doc[positive], positive)
        for key, add in _RESTRICTIONS.items():
            if key in doc:
                add(draft, doc[key], key)
        for name in ("pattern_not", "pattern_inside", "metavariable_comparison"):
            draft.fields.setdefault(name, None)
    return draft.fields, [f"rule {draft.fields['id']}: {note}" for note in draft.notes]
