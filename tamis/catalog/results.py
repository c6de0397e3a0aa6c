"""Queries over findings: reports, weakness coverage, triage, rule tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import tamis
from tamis.catalog import relations as R
from tamis.catalog import rules as C
from tamis.catalog.scans import SQL_DOC_FINDINGS, SQL_PAGE_FINDINGS
from tamis.catalog.sqlgen import all_matches
from tamis.catalog.sqlgen import findings as sql_findings
from tamis.functions.nodes import callees, node_snippet, normalise_kind
from tamis.operators import coverage as K
from tamis.operators.findings import FINDING_COLUMNS, ordered
from tamis.operators.matching import compile_rules
from tamis.operators.triage import patched_files, triage, verified
from tamis.plans import reports
from tamis.plans.coverage_report import ORDER, coverage_report
from tamis.plans.rule_test import rule_test, rule_test_totals
from tamis.plans.scan import raw_findings, scan_files
from tamis.plans.settle import settled, shared_folder
from tamis.sources.files import spread
from tamis.sources.suppressions import Suppression
from tamis.streaming.scan_stream import (
    latest_findings,
    scan_stream,
    scan_stream_latest,
    stream_findings,
    text_stream,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return scan_files(R.pages(spark, d), C.PAGE_RULES).findings


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return scan_files(R.documents(spark, d), C.TEXT_RULES).findings


_LEVEL = "CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END"
_SCORE = "CASE severity WHEN 'ERROR' THEN '8.0' WHEN 'WARNING' THEN '5.0' ELSE '3.0' END"


@query(
    "sarif_results",
    f"""SELECT rule_id, {_LEVEL} AS level, message, path AS uri, line AS start_line,
      col + 1 AS start_column FROM {SQL_PAGE_FINDINGS}""",
)
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return reports.sarif_results(_pages(spark, d))


@query(
    "sarif_rules",
    f"""SELECT rule_id, message, {_LEVEL} AS level, {_SCORE} AS security_severity,
      min(path) AS path FROM {SQL_DOC_FINDINGS} GROUP BY 1, 2, 3, 4""",
)
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = reports.sarif_rules(_docs(spark, d))
    return rules.select("rule_id", "message", "level", "security_severity", "path")


@query(
    "junit_suites",
    f"SELECT path, count(*) AS tests, count(*) AS failures FROM {SQL_PAGE_FINDINGS} GROUP BY 1",
)
def junit_suites(spark: SparkSession, d: str) -> DataFrame:
    return reports.junit_suites(_pages(spark, d))


def _xml(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


_NL = "chr(10)"
_CASE = (
    f"'    <testcase classname=\"' || {_xml('path')} || '\" name=\"' || {_xml('rule_id')} || ':' "
    f"|| line || '\" time=\"0\">' || {_NL} || '      <failure type=\"' || severity || "
    f"'\" message=\"' || {_xml('message')} || '\">' || {_xml('message')} || {_NL} || "
    f"{_xml('snippet')} || {_NL} || coalesce('fix: ' || {_xml('fix')} || {_NL}, '') || "
    f"'</failure>' || {_NL} || '    </testcase>'"
)


@query(
    "junit_report",
    f"""SELECT '<?xml version="1.0" encoding="UTF-8"?>' || {_NL} || '<testsuites name="tamis" tests="'
      || count(*) || '" failures="' || count(*) || '" errors="0" time="0">' AS text
      FROM {SQL_PAGE_FINDINGS}
    UNION ALL
    SELECT '  <testsuite name="' || {_xml('path')} || '" tests="' || count(*) || '" failures="'
      || count(*) || '" errors="0" time="0">' FROM {SQL_PAGE_FINDINGS} GROUP BY path
    UNION ALL SELECT {_CASE} FROM {SQL_PAGE_FINDINGS}
    UNION ALL SELECT '  </testsuite>' FROM (SELECT DISTINCT path FROM {SQL_PAGE_FINDINGS})
    UNION ALL SELECT '</testsuites>'""",
)
def junit_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.junit_report(_pages(spark, d))




@query(
    "json_report",
    f"""SELECT '[' AS text UNION ALL SELECT ']' UNION ALL
    SELECT CASE WHEN row_number() OVER (ORDER BY path, line,
        list_position(['token-literal', 'mail-address', 'licence-notice', 'phone-number'], rule_id))
      = 1 THEN '' ELSE ',' END || to_json({{{', '.join(f"'{c}': {c}" for c in FINDING_COLUMNS)}}})
    FROM {SQL_DOC_FINDINGS}""",
)
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.json_report(_docs(spark, d))


_POSITION = "list_position(['token-literal', 'mail-address', 'licence-notice', 'phone-number'], rule_id)"
_SARIF_HEAD = (
    f'{{"version":"2.1.0","$schema":"{reports.SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
    f'{{"name":"tamis","version":"{tamis.__version__}","rules":['
)


@query(
    "findings_ordered",
    f"""SELECT row_number() OVER (ORDER BY path, line, {_POSITION}) - 1 AS place, rule_id, path, line
    FROM {SQL_DOC_FINDINGS}""",
)
def findings_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row as it comes out of the sort."""
    return R.placed(ordered(_docs(spark, d))).select("place", "rule_id", "path", "line")


@query(
    "sarif_report",
    f"""SELECT '{_SARIF_HEAD}' AS text UNION ALL SELECT ']}}}},"results":[' UNION ALL SELECT ']}}]}}'
    UNION ALL
    SELECT CASE WHEN row_number() OVER (ORDER BY first) = 1 THEN '' ELSE ',' END || to_json({{
      'id': rule_id, 'name': rule_id, 'shortDescription': {{'text': message}},
      'defaultConfiguration': {{'level': level}}, 'properties': {{'security-severity': score}}}})
    FROM (SELECT rule_id, message, {_LEVEL} AS level, {_SCORE} AS score,
            min((path, line, {_POSITION})) AS first FROM {SQL_DOC_FINDINGS} GROUP BY 1, 2, 3, 4)
    UNION ALL
    SELECT CASE WHEN row_number() OVER (ORDER BY path, line, {_POSITION}) = 1 THEN '' ELSE ',' END
      || to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': message}},
        'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}},
          'region': {{'startLine': line, 'startColumn': col + 1}}}}}}]}})
    FROM {SQL_DOC_FINDINGS}""",
)
def sarif_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.sarif_report(_docs(spark, d))


@query(
    "evidence_lines",
    f"""SELECT to_json({{'rule': rule_id, 'path': path, 'line': line, 'snippet': snippet}})::VARCHAR
    AS text FROM {SQL_DOC_FINDINGS}""",
)
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.evidence_lines(_docs(spark, d))


@query(
    "table_report",
    f"""SELECT 'tamis: ' || count(*) || ' finding(s)' AS text FROM {SQL_DOC_FINDINGS} UNION ALL
    SELECT path || ':' || line || ' [' || severity || '] ' || rule_id || ' - ' || snippet
    FROM {SQL_DOC_FINDINGS}""",
)
def table_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_report(_docs(spark, d))


@query(
    "report_metrics",
    f"""SELECT (SELECT count(*) FROM documents) AS files, 4 AS rules,
      count(*) FILTER (NOT (rule_id = 'phone-number' AND line = 1)) AS findings,
      count(*) FILTER (rule_id = 'phone-number' AND line = 1) AS suppressed, 0 AS cache_hits
    FROM {SQL_DOC_FINDINGS}""",
)
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    entry = Suppression("phone-number", "known", line=1)
    return scan_files(R.documents(spark, d), C.TEXT_RULES, suppressions=[entry]).metrics()


@query(
    "secret_tokens_by_source",
    f"""SELECT split_part(path, '/', 2) AS source, severity, count(*) AS findings,
      count(DISTINCT path) AS files FROM {SQL_DOC_FINDINGS}
    WHERE rule_id IN ('token-literal', 'phone-number') GROUP BY 1, 2""",
)
def secret_tokens_by_source(spark: SparkSession, d: str) -> DataFrame:
    found = scan_files(R.documents(spark, d), [C.TOKEN, C.PHONE]).findings
    per_file = found.groupBy("path", "severity").agg(F.count("*").alias("n"))
    source = F.split("path", "/", 3)[1].alias("source")
    return per_file.groupBy(source, "severity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("files")
    )


# -- weakness coverage -------------------------------------------------------

_FEED = (
    "'{\"cve\": {\"id\": \"CVE-' || (event_id) || '\", \"published\": \"2024-01-0' || "
    "(event_id % 9 + 1) || 'T10:00:00.000\", \"metrics\": {' || "
    "CASE event_id % 4 WHEN 3 THEN '' ELSE '\"cvssMetricV' || "
    "CASE event_id % 4 WHEN 0 THEN '31' WHEN 1 THEN '30' ELSE '2' END || "
    "'\": [{\"cvssData\": {\"baseScore\": ' || (event_id % 10) || '.' || (event_id % 7) || "
    "', \"baseSeverity\": \"' || CASE event_id % 5 WHEN 0 THEN 'critical' ELSE 'HIGH' END || "
    "'\"}}]' END || '}, \"descriptions\": [{\"lang\": \"es\", \"value\": \"No. Uno\"}, "
    "{\"lang\": \"en\", \"value\": \" A flaw in part ' || (event_id) || '. More text. \"}], "
    "\"weaknesses\": [{\"description\": [{\"lang\": \"en\", \"value\": \"CWE-' || "
    "(event_id % 60) || '\"}, {\"lang\": \"en\", \"value\": \"NVD-CWE-noinfo\"}]}, "
    "{\"description\": [{\"lang\": \"en\", \"value\": \"CWE-' || (event_id % 11 + 50) || "
    "'\"}]}]}}'"
)
_ID = "event_id"
_PARSED = f"""(SELECT DISTINCT 'CVE-' || k AS id, '2024-01-0' || (k % 9 + 1) AS published,
    CASE WHEN k % 4 = 3 THEN 0.0 ELSE CAST((k % 10) || '.' || (k % 7) AS DOUBLE) END AS score,
    CASE WHEN k % 4 = 3 THEN '' WHEN k % 5 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
    list_sort(list_distinct(['CWE-' || (k % 60), 'CWE-' || (k % 11 + 50)])) AS cwes,
    'A flaw in part ' || k AS "desc"
  FROM (SELECT {_ID} AS k FROM events))"""
_SEEN = f"(SELECT id, score, unnest(cwes) AS cwe FROM {_PARSED})"

CORPUS = [
    C.Rule(f"r{i:02d}", ("generic",), "INFO", "", ("x",),
           metadata={"cwe": f"CWE-{i}" + (f", CWE-{i // 5}" if i % 2 else "")})
    for i in range(20, 58)
] + [C.Rule("bare", ("generic",), "INFO", "", ("x",))]
_CORPUS_SQL = """(SELECT DISTINCT rule_id, cwe FROM (
    SELECT 'r' || i AS rule_id, 'CWE-' || i AS cwe FROM range(20, 58) t(i) UNION ALL
    SELECT 'r' || i, 'CWE-' || (i // 5) FROM range(20, 58) t(i) WHERE i % 2 = 1))"""


def _feed(spark: SparkSession, d: str) -> DataFrame:
    events = spread(R.table(spark, d, "events"))
    return K.parse_feed(events.selectExpr(f"{_FEED} AS json"))


def _corpus(spark: SparkSession) -> DataFrame:
    return K.rule_cwes(compile_rules(CORPUS).rule_table(spark))


@query("cve_feed", f"""SELECT id, published, score, severity, array_to_string(cwes, ' ') AS cwes,
    "desc" FROM {_PARSED}""")
def cve_feed(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d).withColumn("cwes", F.array_join("cwes", " "))


@query(
    "findings_rollup",
    f"""SELECT severity, language, rule_id, CAST(GROUPING(severity, language, rule_id) AS INT) AS level,
      count(*) AS findings, count(DISTINCT path) AS files
    FROM (SELECT severity, language, rule_id, path FROM {SQL_DOC_FINDINGS}
      UNION ALL SELECT severity, language, rule_id, path FROM {SQL_PAGE_FINDINGS})
    GROUP BY ROLLUP (severity, language, rule_id)""",
)
def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).select("severity", "language", "rule_id", "path").union(
        _pages(spark, d).select("severity", "language", "rule_id", "path")
    )
    return reports.findings_rollup(both)


@query(
    "cwe_coverage_gap",
    f"""SELECT cwe, count(*) AS n_cves, array_to_string(
      list_transform((list_sort(list({{'s': -score, 'id': id}})))[1:3], lambda x: x.id), ' ') AS examples
    FROM {_SEEN} WHERE cwe NOT IN (SELECT cwe FROM {_CORPUS_SQL}) GROUP BY 1""",
)
def cwe_coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    gaps = K.coverage_gaps(_feed(spark, d), _corpus(spark))
    return gaps.withColumn("examples", F.array_join("examples", " "))


@query(
    "cve_gap_report",
    f"""SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, cwe) AS INT) AS place, cwe, count(*) AS n_cves
    FROM {_SEEN} WHERE cwe NOT IN (SELECT cwe FROM {_CORPUS_SQL}) GROUP BY cwe""",
)
def cve_gap_report(spark: SparkSession, d: str) -> DataFrame:
    return K.gap_report(_feed(spark, d), _corpus(spark)).select("place", "cwe", "n_cves")


@query(
    "cwe_covered_rules",
    f"""SELECT cwe, array_to_string((list_sort(list(rule_id)))[1:4], ' ') AS rules,
      count(*) > 4 AS more FROM {_CORPUS_SQL}
    WHERE cwe IN (SELECT cwe FROM {_SEEN}) GROUP BY 1""",
)
def cwe_covered_rules(spark: SparkSession, d: str) -> DataFrame:
    found = K.covered_classes(_feed(spark, d), _corpus(spark))
    return found.withColumn("rules", F.array_join("rules", " "))


@query(
    "cve_status",
    f"""SELECT coverage, severity, count(*) AS n FROM (
      SELECT p.severity, CASE WHEN EXISTS (SELECT 1 FROM {_SEEN} s, {_CORPUS_SQL} c
        WHERE s.id = p.id AND s.cwe = c.cwe) THEN 'covered' ELSE 'GAP' END AS coverage
      FROM {_PARSED} p) GROUP BY ALL""",
)
def cve_status(spark: SparkSession, d: str) -> DataFrame:
    rated = K.with_coverage(_feed(spark, d), _corpus(spark))
    return rated.groupBy("coverage", "severity").agg(F.count("*").alias("n"))


@query(
    "cve_top_by_score",
    f"SELECT id, score, severity FROM {_PARSED} ORDER BY score DESC, id LIMIT 40",
)
def cve_top_by_score(spark: SparkSession, d: str) -> DataFrame:
    """The report's table of the forty highest scores."""
    return K.by_score(_feed(spark, d), 40).select("id", "score", "severity")


@query(
    "cve_summary",
    f"""SELECT count(*) AS cves, count(*) FILTER (severity = 'CRITICAL') AS critical,
      count(*) FILTER (severity = 'HIGH') AS high,
      (SELECT count(DISTINCT cwe) FROM {_SEEN}) AS observed_cwes,
      (SELECT count(DISTINCT cwe) FROM {_SEEN} WHERE cwe IN (SELECT cwe FROM {_CORPUS_SQL}))
        AS covered_cwes,
      (SELECT count(DISTINCT cwe) FROM {_SEEN} WHERE cwe NOT IN (SELECT cwe FROM {_CORPUS_SQL}))
        AS gap_cwes, 39 AS rules, 38 AS rules_with_cwe
    FROM {_PARSED}""",
)
def cve_summary(spark: SparkSession, d: str) -> DataFrame:
    rules = compile_rules(CORPUS).rule_table(spark)
    return K.coverage_summary(_feed(spark, d), _corpus(spark), rules)


_COUNTS = SQL["cve_summary"]
_HEADS = {
    0: ["'# Advisories and rules'", "''", "'| Count | Value |'", "'| --- | --- |'",
        "'| Advisories | ' || cves || ' (' || critical || ' critical, ' || high || ' high) |'",
        "'| Published | ' || first_day || ' to ' || last_day || ' |'",
        "'| Weakness classes | ' || observed_cwes || ' |'", "'| Classes with a rule | ' || covered_cwes || ' |'",
        "'| Classes without a rule | ' || gap_cwes || ' |'",
        "'| Rules | ' || rules || ', with a class: ' || rules_with_cwe || ' |'"],
    1: ["''", "'## Classes without a rule'", "''", "'| Class | Advisories | Highest scores |'", "'| --- | --- | --- |'"],
    2: ["''", "'## Classes with a rule'", "''"],
    3: ["''", "'## Advisories by score (' || least(cves, 40) || ' of ' || cves || ')'", "''",
        "'| Advisory | Score | Severity | Classes | Coverage | Text |'", "'| --- | --- | --- | --- | --- | --- |'"],
}
_HEAD_SQL = " UNION ALL ".join(
    f"SELECT {section} AS section, false AS is_row, {i}.0 AS rank, '' AS key, {text} AS text FROM counts"
    for section, texts in _HEADS.items()
    for i, text in enumerate(texts)
)


@query(
    "cve_report",
    f"""WITH counts AS (SELECT *, (SELECT min(published) FROM {_PARSED}) AS first_day,
        (SELECT max(published) FROM {_PARSED}) AS last_day FROM ({_COUNTS})),
      gaps AS ({SQL["cwe_coverage_gap"]}), covered AS ({SQL["cwe_covered_rules"]}),
      best AS (SELECT * FROM {_PARSED} ORDER BY score DESC, id LIMIT 40)
    SELECT CAST(row_number() OVER (ORDER BY section, is_row, rank, key) AS INT) AS line, text FROM ({_HEAD_SQL}
      UNION ALL SELECT 1, true, -n_cves, cwe, '| ' || cwe || ' | ' || n_cves || ' | ' || replace(examples, ' ', ', ') || ' |' FROM gaps
      UNION ALL SELECT 2, true, 0, cwe, '- **' || cwe || '**: ' || replace(rules, ' ', ', ') || CASE WHEN more THEN ' …' ELSE '' END FROM covered
      UNION ALL SELECT 3, true, -score, id, '| ' || id || ' | ' || score || ' | ' || severity || ' | ' || array_to_string(cwes, ', ')
        || ' | ' || CASE WHEN list_has_any(cwes, (SELECT list(cwe) FROM {_CORPUS_SQL})) THEN 'covered' ELSE 'GAP' END
        || ' | ' || "desc" || ' |' FROM best)""",
)
def cve_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report with the numbers of its lines: one per weakness class and
    the forty highest scores, so few enough for one window."""
    rules = compile_rules(CORPUS).rule_table(spark)
    lines = coverage_report(_feed(spark, d), _corpus(spark), rules)
    return lines.select(F.row_number().over(Window.orderBy(*ORDER)).alias("line"), "text")


# -- triage and rule tests ---------------------------------------------------

_WORDS = "execute|eval|system|innerHTML|exec\\(|raw\\(|unserialize|pickle|readObject|Deserialize|AKIA|PRIVATE KEY"


@query(
    "triage_heuristic",
    f"""SELECT rule_id, path, line, p >= 0.5 AS is_tp, p AS confidence FROM (
      SELECT *, CASE WHEN regexp_matches(concat_ws(' ', rule_id, severity, message, fix, path,
        language, snippet), '{_WORDS}') THEN 0.9 ELSE 0.4 END::DOUBLE AS p FROM {SQL_DOC_FINDINGS})""",
)
def triage_heuristic(spark: SparkSession, d: str) -> DataFrame:
    scored = triage(_docs(spark, d))
    return scored.select("rule_id", "path", "line", "is_tp", "confidence")


_TOKENS = sql_findings(R.SQL_DOCUMENTS, [C.SQL_TEXT_RULES[0]])


@query(
    "verify_fixes",
    f"SELECT rule_id, path, line FROM {_TOKENS} WHERE line % 2 = 1",
)
def verify_fixes(spark: SparkSession, d: str) -> DataFrame:
    """A real fix on odd lines; on even ones the secret is only moved to
    another name, which the scan finds again."""
    files = R.documents(spark, d)
    found = settled(raw_findings(files, [C.TOKEN]))
    moved = F.regexp_replace("snippet", "token = ", "other_token = ")
    fixes = found.select(
        "path",
        "line",
        F.when(F.col("line") % 2 == 1, "token = read()").otherwise(moved).alias("fixed_snippet"),
    )
    after = raw_findings(patched_files(files, fixes), [C.TOKEN], carry=("patched_line",))
    return verified(found, after).select("rule_id", "path", "line")


_FIXTURE_ID = "CASE doc_id % 5 WHEN 0 THEN 'phone-number' WHEN 1 THEN 'missing' ELSE 'token-literal' END"
_FIXTURE_NAME = (
    "CASE WHEN contains(text, 'token = \"') OR contains(text, ') 555-') THEN 'fail' "
    "WHEN doc_id % 3 = 0 THEN 'notes' ELSE 'pass' END || doc_id || '.txt'"
)
_FIXTURES = f"(SELECT {_FIXTURE_ID} AS rule_id, {_FIXTURE_NAME} AS file_name, path, known FROM (" \
    f"SELECT *, {R.DOC_PATH} AS path, doc_id % 5 <> 1 AS known FROM documents))"
_TESTED = f"""(SELECT *, CASE expected WHEN 'fail' THEN hits > 0 WHEN 'pass' THEN hits = 0
    ELSE true END AS ok FROM (
  SELECT x.rule_id, x.file_name, x.known,
    CASE WHEN file_name LIKE 'fail%' THEN 'fail' WHEN file_name LIKE 'pass%' THEN 'pass' END AS expected,
    count(f.rule_id) AS hits
  FROM {_FIXTURES} x LEFT JOIN {all_matches(R.SQL_DOCUMENTS, C.SQL_TEXT_RULES)} f ON f.path = x.path AND f.rule_id = x.rule_id
  GROUP BY 1, 2, 3))"""


def _tested(spark: SparkSession, d: str) -> DataFrame:
    docs = R.table(spark, d, "documents")
    fixtures = docs.selectExpr(
        f"{_FIXTURE_ID} AS rule_id", f"{_FIXTURE_NAME} AS file_name", "text"
    )
    return rule_test(fixtures, [C.TOKEN, C.PHONE])


@query("rule_fixtures", f"SELECT rule_id, file_name, known, expected, hits, ok FROM {_TESTED}")
def rule_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d)


@query(
    "rule_fixture_totals",
    f"""SELECT count(*) FILTER (known) AS tested, count(*) FILTER (known AND NOT ok) AS failed,
      count(*) FILTER (NOT known) AS unknown FROM {_TESTED}""",
)
def rule_fixture_totals(spark: SparkSession, d: str) -> DataFrame:
    return rule_test_totals(_tested(spark, d))


# -- syntax nodes ------------------------------------------------------------

_KIND = (
    "CASE p_size % 6 WHEN 0 THEN 'call_expression' WHEN 1 THEN 'while_statement' "
    "WHEN 2 THEN 'interpreted_string_literal' WHEN 3 THEN 'call' WHEN 4 THEN 'short_var_declaration' "
    "ELSE 'block' END"
)
_NODE_TEXT = "' ' || replace(p_name, ' ', '.') || ' (' || chr(10) || p_brand || ')'"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = R.table(spark, d, "part").selectExpr(
        "p_partkey AS node_id", f"{_KIND} AS ts_kind", f"{_NODE_TEXT} AS text"
    )
    return nodes.withColumn("kind", normalise_kind(F.col("ts_kind")))


@query(
    "node_kinds",
    f"""SELECT node_id, CASE ts_kind WHEN 'call_expression' THEN 'call' WHEN 'while_statement' THEN 'loop'
      WHEN 'interpreted_string_literal' THEN 'string' WHEN 'call' THEN 'call'
      WHEN 'short_var_declaration' THEN 'assign' ELSE 'other:block' END AS kind,
      replace(left(text, 14), chr(10), ' ') AS snippet
    FROM (SELECT p_partkey AS node_id, {_KIND} AS ts_kind, {_NODE_TEXT} AS text FROM part)""",
)
def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("node_id", "kind", node_snippet(F.col("text"), 14).alias("snippet"))


@query(
    "node_callees",
    f"""SELECT replace(p_name, ' ', '.') AS callee, count(*) AS calls FROM part
    WHERE p_size % 6 IN (0, 3) GROUP BY 1""",
)
def node_callees(spark: SparkSession, d: str) -> DataFrame:
    return callees(_nodes(spark, d)).groupBy("callee").agg(F.count("*").alias("calls"))


# -- streaming ---------------------------------------------------------------


@query("stream_scan", f"SELECT rule_id, severity, path, line, col, snippet FROM {SQL_DOC_FINDINGS}")
def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream that ends when all of them are read."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = R.table(spark, d, "documents")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    # as a pattern, for the table is one file or a folder of them
    files = text_stream(
        spark, f"{d}/documents.parque[t]", schema, F.expr(R.DOC_PATH), F.col("text")
    )
    scan_stream(files, C.TEXT_RULES, f"{out}/findings", f"{out}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    found = stream_findings(spark, f"{out}/findings")
    return found.select("rule_id", "severity", "path", "line", "col", "snippet")


@query("stream_redelivered", f"SELECT rule_id, severity, path, line, col, snippet FROM {SQL_DOC_FINDINGS}")
def stream_redelivered(spark: SparkSession, d: str) -> DataFrame:
    """All documents come with a line in front, then as they are, then once
    more; the stream is started anew each time."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = R.table(spark, d, "documents").selectExpr(f"{R.DOC_PATH} AS path", "text")
    edited = docs.withColumn("text", F.concat(F.lit("token = \"abcdef0123\"\n"), F.col("text")))
    for delivery in (edited, docs, docs):
        delivery.write.mode("append").parquet(f"{at}/in")
        files = text_stream(
            spark, f"{at}/in", "path string, text string", F.col("path"), F.col("text")
        )
        scan_stream_latest(files, C.TEXT_RULES, f"{at}/out", f"{at}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    found = latest_findings(spark, f"{at}/out")
    return found.select("rule_id", "severity", "path", "line", "col", "snippet")
