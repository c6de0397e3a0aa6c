"""Path globs as anchored regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB_PART = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
# What each glob operator may span.
_GLOB_REGEX = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str, *, any_suffix: bool = False) -> str:
    """``*`` and ``?`` stay within a path segment, ``**`` crosses segments and
    ``**/`` may also stand for no directory. With ``any_suffix`` the glob may
    also match after any slash."""
    body = "".join(_GLOB_REGEX.get(p, re.escape(p)) for p in _GLOB_PART.findall(glob))
    return f"(?s)^{'(?:.*/)?' if any_suffix else ''}{body}\\z"


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_match(glob: str, text: Column) -> Column:
    return F.rlike(text, F.lit(glob_regex(glob)))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, or null when it is not below it."""
    if root in ("", None):
        return F.lit(None).cast("string")
    prefix = "./" if root == "." else root.rstrip("/") + "/"
    rest = F.ltrim(F.substring(path, len(prefix) + 1, 2**31 - 1), F.lit("/"))
    return F.when(F.startswith(path, F.lit(prefix)) & (F.length(rest) > 0), rest)


def path_hits(pattern: str, path: Column, root: str = "") -> Column:
    """A plain pattern is a substring test; a glob may match at any directory."""
    if is_glob(pattern):
        regex = F.lit(glob_regex(pattern, any_suffix=True))
        hit = lambda c: F.rlike(c, regex)
    else:
        hit = lambda c: F.contains(c, F.lit(pattern))
    return hit(path) | F.coalesce(hit(relative_path(path, root)), F.lit(False))


def path_allowed(
    path: Column, root: str = "", include: tuple = (), exclude: tuple = ()
) -> Column:
    """No exclude may hit; when there are includes, one must."""
    any_of = lambda globs: reduce(
        lambda a, b: a | b, [path_hits(g, path, root) for g in globs]
    )
    keep = F.lit(True)
    if exclude:
        keep = keep & ~any_of(exclude)
    if include:
        keep = keep & any_of(include)
    return keep
