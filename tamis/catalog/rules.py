"""Rules of the ready-made queries, and their regexes written out by hand for
the SQL counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from tamis.sources.rules import Flow, Rule


@dataclass(frozen=True)
class SqlRule:
    """A rule as its SQL counterpart sees it. ``keep`` is a condition on the
    match in column ``hit``; ``never`` and ``inside`` are regexes."""

    id: str
    severity: str
    message: str
    regexes: tuple[str, ...]
    keep: str = "true"
    never: str = ""
    inside: str = ""
    languages: tuple[str, ...] = ("generic",)
    fix: str | None = None


def _capture(regex: str, group: int = 1) -> str:
    return f"regexp_extract(hit, '(?s){regex}', {group})"


_GENERIC = ("generic",)
_HTML = ("html",)

TOKEN = Rule(
    "token-literal", _GENERIC, "ERROR", "token in text", ('token = "$VALUE"',),
    fix="use the environment", metavariable_regex={"VALUE": "^[0-9a-f]{20,}$"},
    metadata={"cwe": "CWE-798"},
)
MAIL = Rule(
    "mail-address", _GENERIC, "WARNING", "mail address & host", ("@mail$HOST.example.com",),
    metavariable_regex={"HOST": r"^\d+$"}, metadata={"cwe": "CWE-359"},
)
LICENCE = Rule(
    "licence-notice", _GENERIC, "INFO", "licence notice",
    ("Licensed under $NAME.", "Released under the $NAME License.",
     "licensed under the $NAME, version"),
    metadata={"cwe": "CWE-1357, CWE-1104"},
)
PHONE = Rule(
    "phone-number", _GENERIC, "HIGH", "phone number", ("+1 ($AREA) 555-",),
    metavariable_regex={"AREA": r"^\d{3}$"}, metadata={"owasp": "A3"},
)
TEXT_RULES = [TOKEN, MAIL, LICENCE, PHONE]

_TOKEN = r'token\s*=\s*"(.+?)"'
_MAIL = r"@mail(.+?)\.example\.com"
_PHONE = r"\+1\s*\((.+?)\)\s*555-"
LICENCE_REGEXES = (
    r"Licensed\s*under\s*(.+?)\.",
    r"Released\s*under\s*the\s*(.+?)\s*License\.",
    r"licensed\s*under\s*the\s*(.+?),\s*version",
)
SQL_TEXT_RULES = [
    SqlRule("token-literal", "ERROR", "token in text", (_TOKEN,),
            f"regexp_matches({_capture(_TOKEN)}, '^[0-9a-f]{{20,}}$')", fix="use the environment"),
    SqlRule("mail-address", "WARNING", "mail address & host", (_MAIL,),
            f"regexp_matches({_capture(_MAIL)}, '^[0-9]+$')"),
    SqlRule("licence-notice", "INFO", "licence notice", LICENCE_REGEXES),
    SqlRule("phone-number", "HIGH", "phone number", (_PHONE,),
            f"regexp_matches({_capture(_PHONE)}, '^[0-9]{{3}}$')"),
]

# Constraints in all of their language: Unicode and POSIX classes, the very end,
# {,n}, a named group; the last one is broken and only costs its own rule.
CLASS_RULES = [
    Rule("letters", _GENERIC, "INFO", "letters", (", $WORD de ",), metavariable_regex={"WORD": r"^\p{L}+\z"}),
    Rule("posix", _GENERIC, "INFO", "letters", (", $WORD de ",), metavariable_regex={"WORD": r"^(?P<w>[[:alpha:]]{,9})$"}),
    Rule("broken", _GENERIC, "INFO", "broken", (", $WORD de ",), metavariable_regex={"WORD": r"(?P<q>a)(?P=q)"}),
]
_OF = r",\s*(.+?)\s*de\s*"
SQL_CLASS_RULES = [
    SqlRule("letters", "INFO", "letters", (_OF,), f"regexp_matches({_capture(_OF)}, '^\\p{{L}}+$')"),
    SqlRule("posix", "INFO", "letters", (_OF,), f"regexp_matches({_capture(_OF)}, '^[A-Za-z]{{0,9}}$')"),
]

OF_WORD = Rule("of-word", _GENERIC, "INFO", "words", (", $WORD de ",))
SQL_OF_WORD = SqlRule("of-word", "INFO", "words", (r",\s*(.+?)\s*de\s*",))

SCRIPT = Rule("inline-script", _HTML, "ERROR", "script <in> page", ("<script>$CODE</script>",))
STYLE = Rule("inline-style", _HTML, "INFO", "style in page", ("<style>...</style>",))
ADVERT = Rule(
    "numbered-ad", _HTML, "WARNING", "advert", ("<!-- ad $N -->",),
    metavariable_comparison="$N >= 1",
)
PAGE_RULES = [SCRIPT, STYLE, ADVERT]
_AD = r"<!--\s*ad\s*(.+?)\s*-->"
SQL_PAGE_RULES = [
    SqlRule("inline-script", "ERROR", "script <in> page", (r"<script>(.+?)</script>",),
            languages=_HTML),
    SqlRule("inline-style", "INFO", "style in page", (r"<style>(.*?)</style>",), languages=_HTML),
    SqlRule("numbered-ad", "WARNING", "advert", (_AD,),
            f"coalesce(try_cast(regexp_extract({_capture(_AD)}, '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE)"
            " >= 1, true)", languages=_HTML),
]

CODE_NOT = Rule(
    "unlogged-command", ("python", "go", "generic"), "ERROR", "command", ("run_cmd($ARGS)",),
    pattern_not="run_cmd(w)",
)
CODE_INSIDE = Rule(
    "input-user", ("javascript",), "WARNING", "uses input", ("import $WHAT\n",),
    pattern_inside="read_input(...)",
)
FLOW = Rule(
    "flow-command", _GENERIC, "ERROR", "input reaches a command",
    flow=Flow(("read_input(...)",), ("run_cmd(...)",), ("escape(...)",)),
)
BRACE_FLOW = Rule(
    "flow-brace-function", ("javascript",), "ERROR", "result reaches a command",
    flow=Flow(("read_input(...)",), ("run_cmd(...)",), ("escape(...)",)),
)
FUNCTION_FLOW = Rule(
    "flow-function", ("python",), "ERROR", "result reaches a command",
    flow=Flow(("read_input(...)",), ("run_cmd(...)",), ("escape(...)",)),
)


# -- a pack of the size of a whole rule corpus -------------------------------

_NUMBERS = range(0, 10_000, 8)
_SYLLABLES = ("an", "at", "ea", "ed", "en", "er", "es", "ha", "he", "hi", "in", "is", "nd", "nt", "on", "or", "ou", "re", "sh", "st", "th", "ti", "tion", "wh")


def large_pack(size: int | None = None) -> list[Rule]:
    """A rule per listed phone number and per two syllables that start a
    sentence: over 1,800, of which ``size`` are taken evenly."""
    texts = [f"555-{n:04d}" for n in _NUMBERS] + [a.capitalize() + b for a in _SYLLABLES for b in _SYLLABLES]
    texts = texts[:: max(len(texts) // size, 1)][:size] if size else texts
    return [Rule(f"listed-{t}", ("generic",), "INFO", "listed text", (t,)) for t in texts]


SQL_LARGE_PACK = f"""(SELECT '555-' || lpad(CAST(i * {_NUMBERS.step} AS VARCHAR), 4, '0') AS listed
  FROM range({len(_NUMBERS)}) r(i)
  UNION ALL SELECT upper(a[1]) || a[2:] || b FROM (SELECT unnest({list(_SYLLABLES)}) AS a), (SELECT unnest({list(_SYLLABLES)}) AS b))"""
