"""Licence policy files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml

DEFAULT_FILE = ".tamis-licences.yml"


@dataclass(frozen=True)
class Policy:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    # warn, ignore or error; warn and error both report the package.
    unlicensed: str = "warn"
    # direct or all
    scope: str = "direct"


def parse_policy(text: str) -> Policy:
    """Unknown keys are ignored; a text that is no mapping is the default."""
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        return Policy()
    if not isinstance(doc, dict):
        return Policy()

    def names(key: str) -> tuple[str, ...]:
        value = doc.get(key)
        return tuple(
            " ".join(v.split()) for v in value if isinstance(v, str)
        ) if isinstance(value, list) else ()

    def choice(key: str, allowed: tuple[str, ...], default: str) -> str:
        value = doc.get(key)
        value = value.lower() if isinstance(value, str) else default
        return value if value in allowed else default

    return Policy(
        allow=names("allow"),
        deny=names("deny"),
        unlicensed=choice("unlicensed", ("ignore", "error"), "warn"),
        scope=choice("scope", ("all",), "direct"),
    )


def load_policy(root: str, explicit: str | None = None) -> Policy:
    """A named file must exist; the default file at the root may be missing."""
    if explicit is not None:
        return parse_policy(Path(explicit).read_text(encoding="utf-8"))
    default = Path(root) / DEFAULT_FILE
    return parse_policy(default.read_text(encoding="utf-8")) if default.is_file() else Policy()
