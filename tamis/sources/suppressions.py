"""Suppression files."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from pathlib import Path

import yaml

# Conventional names at the scan root, the first one found is used.
DEFAULT_FILES = (".tamis-suppressions.yml", ".tamis-suppressions.yaml")
_KEYS = {"rule", "path", "line", "reason", "owner", "expires"}


class SuppressionError(ValueError):
    """An entry cannot be used."""


@dataclass(frozen=True)
class Suppression:
    rule: str
    reason: str
    path: str | None = None
    line: int | None = None
    owner: str | None = None
    expires: str | None = None

    def is_expired(self, today: str) -> bool:
        # Zero-padded dates order like their text.
        return self.expires is not None and today > self.expires


def valid_date(text: str) -> bool:
    """YYYY-MM-DD with month 1-12 and day 1-31, whatever the month."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text, re.ASCII)
    return bool(m) and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31


def _entry(doc, src: str) -> Suppression:
    if not isinstance(doc, dict):
        raise SuppressionError(f"{src}: an entry has to be a mapping of keys")
    unknown = set(doc) - _KEYS
    if unknown:
        raise SuppressionError(f"{src}: no such key as {sorted(unknown)[0]!r}")
    rule, reason = str(doc.get("rule") or ""), str(doc.get("reason") or "")
    if not rule.strip():
        raise SuppressionError(f"{src}: an entry names no rule")
    if not reason.strip():
        raise SuppressionError(f"{src}: the entry for {rule} gives no reason")
    line = doc.get("line") or None
    if line is not None and not str(line).isdigit():
        raise SuppressionError(f"{src}: the entry for {rule} has a line that is no number")
    expires = doc.get("expires") or None
    if expires is not None and not valid_date(str(expires)):
        raise SuppressionError(f"{src}: the entry for {rule} has no valid date in expires")
    return Suppression(
        rule=rule,
        reason=reason,
        path=doc.get("path") or None,
        line=int(line) if line is not None else None,
        owner=doc.get("owner") or None,
        expires=expires,
    )


def parse_suppressions(text: str, src: str = "<text>") -> list[Suppression]:
    """A list of entries or a single one. Scalars are read as written."""
    try:
        docs = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise SuppressionError(f"parsing suppressions {src}: {e}") from e
    return [_entry(d, src) for d in (docs if isinstance(docs, list) else [docs])]


def find_suppressions(root: str, explicit: tuple[str, ...] | list[str] = ()) -> list[Suppression]:
    """Explicit files replace the search at the root directory."""
    files = [Path(f) for f in explicit]
    if not explicit and Path(root).is_dir():
        files = [p for n in DEFAULT_FILES if (p := Path(root, n)).is_file()][:1]
    return [e for f in files for e in parse_suppressions(f.read_text(encoding="utf-8"), str(f))]


def live_suppressions(
    entries: list[Suppression], today: str | None = None
) -> tuple[list[Suppression], list[str]]:
    """(entries still in force, a warning per expired one). Days are UTC."""
    today = today or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d")
    live = [e for e in entries if not e.is_expired(today)]
    gone = [
        f"suppression for rule {e.rule} expired {e.expires} and no longer applies"
        for e in entries
        if e.is_expired(today)
    ]
    return live, gone
