"""Language of a file from its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import basename

# File suffixes (case-sensitive) and the language each selects.
SUFFIXES = {
    "python": (".py",),
    "javascript": (".js", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "go": (".go",),
    "java": (".java",),
    "ruby": (".rb",),
    "php": (".php",),
    "csharp": (".cs",),
    "terraform": (".tf", ".tfvars"),
    "yaml": (".yaml", ".yml"),
    "scala": (".scala",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "c": (".c", ".h"),
    "ocaml": (".ml", ".mli"),
    "kotlin": (".kt", ".kts"),
    "bash": (".sh", ".bash", ".zsh"),
    "rust": (".rs",),
    "swift": (".swift",),
    "dart": (".dart",),
    "elixir": (".ex", ".exs", ".heex"),
    "lua": (".lua",),
    "powershell": (".ps1", ".psm1"),
    "sql": (".sql",),
    "json": (".json",),
    "html": (".html", ".htm"),
}
DOCKERFILE = "dockerfile"
GENERIC = "generic"
LANGUAGES = (*SUFFIXES, DOCKERFILE, GENERIC)

# A Dockerfile is known by its basename. That test comes after the yaml
# suffixes and all suffixes listed before them, and ahead of every later one.
_BEFORE_DOCKERFILE = (
    "python", "javascript", "typescript", "go", "java",
    "ruby", "php", "csharp", "terraform", "yaml",
)


def _by_suffix(names: tuple[str, ...]) -> Column:
    """Map from a path's last suffix to a language: one look-up per path."""
    pairs = [F.lit(x) for n in names for suffix in SUFFIXES[n] for x in (suffix, n)]
    return F.create_map(*pairs)


def detect_language(path: Column) -> Column:
    """Language name, or null when nothing in the path tells it."""
    base = basename(path)
    docker = F.startswith(base, F.lit("Dockerfile")) | F.endswith(base, F.lit("Dockerfile"))
    later = tuple(n for n in SUFFIXES if n not in _BEFORE_DOCKERFILE)

    def by(suffix: Column) -> Column:
        return F.coalesce(
            F.element_at(_by_suffix(_BEFORE_DOCKERFILE), suffix),
            F.when(F.contains(path, F.lit("Dockerfile")) & docker, DOCKERFILE),
            F.element_at(_by_suffix(later), suffix),
        )

    suffix = F.concat(F.lit("."), F.substring_index(path, ".", -1))
    return by(F.when(F.contains(path, F.lit(".")), suffix).otherwise(""))


def language_or_generic(path: Column) -> Column:
    return F.coalesce(detect_language(path), F.lit(GENERIC))
