"""Rules: YAML files in, a list of typed rules out (driver side, small data)."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from tamis.sources.portable import RuleSkipped, looks_portable, translate


class RuleError(ValueError):
    """A rule file or a rule-set location cannot be used."""


@dataclass(frozen=True)
class Flow:
    """Source-to-sink rule: alternatives for each role."""

    sources: tuple[str, ...]
    sinks: tuple[str, ...]
    sanitizers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    languages: tuple[str, ...]
    severity: str
    message: str
    patterns: tuple[str, ...] = ()
    category: str | None = None
    fix: str | None = None
    pattern_not: str | None = None
    pattern_inside: str | None = None
    metavariable_regex: dict[str, str] = field(default_factory=dict)
    metavariable_comparison: str | None = None
    flow: Flow | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def positive_patterns(self) -> tuple[str, ...]:
        if self.patterns or not self.flow:
            return self.patterns
        return self.flow.sinks


@dataclass
class RuleSet:
    rules: list[Rule]
    warnings: list[str] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.rules)


def _choices(value, key: str) -> tuple[str, ...]:
    if not isinstance(value, list):
        raise RuleError(f"{key}: a list is needed")
    out = []
    for item in value:
        if isinstance(item, dict) and isinstance(item.get("pattern"), str):
            out.append(item["pattern"])
        elif isinstance(item, str):
            out.append(item)
        else:
            raise RuleError(f"{key}: an entry holds no pattern")
    return tuple(out)


def _parts(value) -> tuple[str, ...]:
    return tuple(p for part in value or [] for p in part.get("patterns", []))


def native_rule(doc) -> Rule:
    """One rule in the native schema. All scalars arrive as written."""
    if not isinstance(doc, dict):
        raise RuleError("a rule has to be a mapping of keys")
    rid = doc.get("id", "")
    for key in ("id", "languages", "severity", "message"):
        if key not in doc:
            raise RuleError(f"rule {rid!r} lacks the key {key}")
    if not isinstance(rid, str) or not rid.strip():
        raise RuleError("a rule needs a name in id")
    langs = doc["languages"]
    if not isinstance(langs, list) or not langs:
        raise RuleError(f"rule {rid!r} names no language")
    # One positive slot is used, in this order; lists are alternatives.
    if "pattern" in doc:
        patterns = (doc["pattern"],)
    elif "pattern-either" in doc:
        patterns = _choices(doc["pattern-either"], "pattern-either")
    elif "patterns" in doc:
        patterns = _choices(doc["patterns"], "patterns")
    elif "taint" in doc:
        patterns = ()
    else:
        raise RuleError(f"rule {rid!r} has nothing to look for")
    flow = None
    if doc.get("taint"):
        taint = doc["taint"]
        flow = Flow(*(_parts(taint.get(k)) for k in ("sources", "sinks", "sanitizers")))
    return Rule(
        id=rid,
        languages=tuple(langs),
        severity=doc["severity"],
        message=doc["message"],
        patterns=patterns,
        category=doc.get("category"),
        fix=doc.get("fix"),
        pattern_not=doc.get("pattern-not"),
        pattern_inside=doc.get("pattern-inside"),
        metavariable_regex=_names_only(doc.get("metavariable-regex") or {}),
        metavariable_comparison=doc.get("metavariable-comparison"),
        flow=flow,
        metadata={k: str(v) for k, v in (doc.get("metadata") or {}).items()},
    )


def _names_only(constraints: dict[str, str]) -> dict[str, str]:
    """Captures are keyed without the dollar sign, so constraints are too."""
    return {k.lstrip("$"): v for k, v in constraints.items()}


def _portable_rule(typed: dict) -> tuple[Rule, list[str]]:
    fields, warnings = translate(typed)
    flow = fields.pop("flow", None)
    fields["metavariable_regex"] = _names_only(fields["metavariable_regex"])
    return Rule(**fields, flow=Flow(*flow) if flow else None), warnings


def parse_rules(text: str, src: str = "<text>") -> RuleSet:
    """A single rule or a list of rules, native and portable schema mixed."""
    try:
        typed = yaml.safe_load(text)
        plain = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise RuleError(f"{src} is not YAML: {e}") from e
    typed = typed if isinstance(typed, list) else [typed]
    plain = plain if isinstance(plain, list) else [plain]
    any_portable = any(looks_portable(t) for t in typed)
    out = RuleSet([])
    for i, (t, p) in enumerate(zip(typed, plain), start=1):
        rid = t.get("id") if isinstance(t, dict) else None
        label = rid if isinstance(rid, str) else f"<item {i}>"
        if looks_portable(t):
            try:
                rule, notes = _portable_rule(t)
            except RuleSkipped as e:
                out.warnings.append(f"{src}: rule {label} left out: {e}")
                continue
            out.warnings += [f"{src}: {n}" for n in notes]
            out.rules.append(rule)
            continue
        try:
            out.rules.append(native_rule(p))
        except RuleError as e:
            if not any_portable:
                raise RuleError(f"{src}: {e}") from e
            out.warnings.append(f"{src}: rule {label} left out: {e}")
    return out


def load_rules_dir(root: str | Path) -> RuleSet:
    """All rule files below ``root``: files in name order, then the
    sub-directories from last name to first; ``tests`` is left out."""
    out = RuleSet([])
    entries = sorted(Path(root).iterdir())
    for p in entries:
        if p.is_file() and p.suffix in (".yaml", ".yml"):
            _extend(out, parse_rules(p.read_text(encoding="utf-8"), str(p)))
    for p in reversed(entries):
        if p.is_dir() and p.name != "tests":
            _extend(out, load_rules_dir(p))
    return out


def _extend(into: RuleSet, more: RuleSet) -> None:
    into.rules += more.rules
    into.warnings += more.warnings


def _is_remote(loc: str) -> bool:
    return (
        loc.startswith(("http://", "https://", "git@", "p/"))
        or loc.endswith(".git")
        or loc == "auto"
    )


def load_rule_set(rules: str | Path | None = None, config: list[str] | tuple = ()) -> RuleSet:
    """``config`` (files or directories) replaces ``rules``. Only local paths
    are read. A missing config path is an error, a missing rules directory
    holds no rules."""
    out = RuleSet([])
    if not config:
        root = Path(rules if rules is not None else default_rule_dir())
        return load_rules_dir(root) if root.is_dir() else out
    for loc in config:
        if _is_remote(loc):
            raise RuleError(f"{loc!r}: rules are only read from local paths")
        p = Path(loc)
        if p.is_dir():
            _extend(out, load_rules_dir(p))
        elif p.is_file():
            _extend(out, parse_rules(p.read_text(encoding="utf-8"), loc))
        else:
            raise RuleError(f"{loc!r}: no such file or folder of rules")
    return out


def default_rule_dir() -> Path:
    return Path(__file__).resolve().parent.parent / "rulepack"
