"""SQL counterparts of scans: matches and their places by string functions."""

from __future__ import annotations

from tamis.catalog.rules import SqlRule


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def all_matches(files: str, rules: list[SqlRule]) -> str:
    """rule_id, severity, message, fix, path, language, line, col, snippet, hit
    for every match of every regex."""
    branches = []
    for r in rules:
        for regex in r.regexes:
            full = quote("(?s)" + regex)
            scope = f" AND regexp_matches(text, {quote('(?s)' + r.inside)})" if r.inside else ""
            if "generic" not in r.languages:
                scope += f" AND language IN ({', '.join(map(quote, r.languages))})"
            never = ""
            if r.never:
                # lines with a match of the excluded pattern
                never = (
                    " AND NOT list_contains(list_transform(range(1, len(regexp_extract_all(text, "
                    f"{quote('(?s)' + r.never)})) + 1), lambda k: "
                    + _line_of("k", "text", quote("(?s)" + r.never))
                    + "), line)"
                )
            branches.append(f"""
SELECT {quote(r.id)} AS rule_id, {quote(r.severity)} AS severity, {quote(r.message)} AS message,
       CAST({quote(r.fix)} AS VARCHAR) AS fix, path, language, line, col, snippet, hit
FROM (
  SELECT *, 1 + length(before) - length(replace(before, chr(10), '')) AS line,
         strlen(split_part(before, chr(10), -1)) AS col,
         regexp_replace(split_part(text, chr(10),
              CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INT)),
              '^\\s+|\\s+$', '', 'g') AS snippet
  FROM (
    SELECT *, hits[i] AS hit,
           coalesce(list_aggregate(list_transform(range(1, i), lambda j: gaps[j] || hits[j]),
                    'string_agg', ''), '') || gaps[i] AS before
    FROM (
      SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (
        SELECT *, regexp_extract_all(text, {full}) AS hits, string_split_regex(text, {full}) AS gaps
        FROM {files} f WHERE regexp_matches(text, {full}){scope}
      )
    )
  )
)
WHERE {r.keep}{never}""")
    return "(" + " UNION ALL ".join(branches) + ")"


def _line_of(k: str, text: str, regex: str) -> str:
    hits = f"regexp_extract_all({text}, {regex})"
    gaps = f"string_split_regex({text}, {regex})"
    before = (
        f"(coalesce(list_aggregate(list_transform(range(1, {k}), lambda j: {gaps}[j] || {hits}[j]), "
        f"'string_agg', ''), '') || {gaps}[{k}])"
    )
    return f"1 + length({before}) - length(replace({before}, chr(10), ''))"


def findings(files: str, rules: list[SqlRule]) -> str:
    """De-duplicated findings: the first column per rule, path, line, snippet."""
    return f"""(SELECT rule_id, severity, message, fix, path, language, CAST(line AS INT) AS line,
       CAST(min(col) AS INT) AS col, snippet
FROM {all_matches(files, rules)} m
GROUP BY rule_id, severity, message, fix, path, language, line, snippet)"""
