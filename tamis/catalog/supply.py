"""Supply-chain queries: every part becomes a manifest of each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.catalog import relations as R
from tamis.catalog import rules as C
from tamis.catalog.scans import SQL_DOC_FINDINGS
from tamis.operators.inventory import (
    DEPENDENCY_COLUMNS,
    ECOSYSTEMS,
    inventory_order,
    merge_inventory,
    parse_manifests,
)
from tamis.operators.licences import is_problem, licence_findings, licence_summary
from tamis.operators.lookalikes import known_names, lookalikes, suspects_by_ecosystem
from tamis.plans.scan import raw_findings
from tamis.sources.files import spread
from tamis.sources.policy import Policy

QUERIES: dict = {}
SQL: dict[str, str] = {}
_NL = " || chr(10) || "


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Package facts of a part, the same expressions on both sides.
NAME = "replace(p_name, ' ', '-')"
BRAND = "lower(replace(p_brand, '#', '-'))"
VER = "p_size || '.' || (p_partkey % 10)"
LICENCE = (
    "CASE p_partkey % 7 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'MIT OR GPL-3.0' "
    "WHEN 3 THEN 'Apache-2.0/LGPL-3.0' WHEN 4 THEN 'MIIT' WHEN 5 THEN 'gpl-3.0' ELSE NULL END"
)
_Q = "'\"'"


def _q(expr: str) -> str:
    return f"{_Q} || {expr} || {_Q}"


def _toml_licence() -> str:
    return f"coalesce(', license = ' || {_q(f'({LICENCE})')}, '')"


_NPM = (
    f"'{{\"packages\": {{\"\": {{\"dependencies\": {{' || {_q(NAME)} || ': \"1\"}}}}, "
    f"\"node_modules/' || {NAME} || '\": {{\"version\": ' || {_q(VER)} "
    f"|| coalesce(', \"license\": ' || {_q(f'({LICENCE})')}, '') || '}}, "
    f"\"node_modules/' || {NAME} || '/node_modules/' || {BRAND} || '\": {{\"version\": \"9\", "
    f"\"license\": 5}}}}}}'"
)
_NPM_OLD = (
    f"'{{\"dependencies\": {{' || {_q(NAME)} || ': {{\"version\": ' || {_q(VER)} || ', "
    f"\"dependencies\": {{' || {_q(BRAND)} || ': {{\"version\": \"3\"}}}}}}}}}}'"
)
_CARGO_LOCK = _NL.join(
    [
        "'[[package]]'", "'name = \"app\"'", "'version = \"0\"'",
        f"'dependencies = [' || {_q(NAME + chr(32) + '|| chr(32) || p_size')} || ']'",
        "'[[package]]'", f"'name = ' || {_q(NAME)}", f"'version = ' || {_q(VER)}",
        "'source = \"r\"'",
        "'[[package]]'", f"'name = ' || {_q(BRAND)}", "'source = \"r\"'",
    ]
)
_CARGO_TOML = _NL.join(
    [
        "'[dependencies]'", f"{_q(NAME)} || ' = {{ version = ' || {_q(VER)} || {_toml_licence()} || ' }}'".replace("{{", "{").replace("}}", "}"),
        "'[target.unix.dev-dependencies]'", f"{_q(BRAND)} || ' = \"^2\"'",
    ]
)
_REQUIREMENTS = _NL.join(
    [
        "'# made by hand'", f"{NAME} || '==' || {VER} || ' ; python_version > \"3\"'",
        f"{BRAND} || '[fast]>=2, <3 --hash=sha256:00 # why'", "'-e .'", "'git+https://host/x.git'",
        f"{NAME} || '==0'", "''",
    ]
)
_PYPROJECT = _NL.join(
    [
        "'[project]'", f"'dependencies = [' || {_q(NAME + chr(32) + '|| chr(126) || chr(61) || ' + VER)} || ']'",
        "'[tool.poetry.dependencies]'", "'python = \"^3.11\"'", f"{_q(BRAND)} || ' = \"*\"'",
    ]
)
_POETRY_LOCK = _NL.join(
    [
        "'[[package]]'", f"'name = ' || {_q(NAME)}", f"'version = ' || {_q(VER)}",
        "'category = ' || CASE WHEN p_partkey % 2 = 0 THEN '\"dev\"' ELSE '\"main\"' END",
        f"coalesce('license = ' || {_q(f'({LICENCE})')}, '')",
    ]
)
_GO_MOD = _NL.join(
    [
        "'module x'", "'require ('", f"chr(9) || {NAME} || ' v' || {VER}",
        f"chr(9) || {BRAND} || ' v1 // indirect'", "')'", "'exclude y v0'",
        f"'require z' || p_size || ' v2'",
    ]
)
_COMPOSER = (
    f"'{{\"packages\": [{{\"name\": ' || {_q(NAME)} || ', \"version\": ' || {_q(VER)} || "
    f"coalesce(', \"license\": [' || {_q(f'({LICENCE})')} || ', \"X\"]', '') || '}}], "
    f"\"packages-dev\": [{{\"name\": ' || {_q(BRAND)} || '}}]}}'"
)
_GEMFILE = _NL.join(
    [
        "'GEM'", "'  remote: https://host/'", "'  specs:'",
        f"'    ' || {NAME} || ' (' || {VER} || '-x86_64-linux)'", f"'      ' || {BRAND} || ' (>= 1)'",
        "''", "'PLATFORMS'", "'  ruby'", "''", "'DEPENDENCIES'", f"'  ' || {NAME} || '!'",
    ]
)
# dependency rows: name, version, license, availability, direct, resolved
_ABSENT = f"CASE WHEN {LICENCE} IS NULL THEN 'absent' ELSE 'declared' END"
_NONE = "CAST(NULL AS VARCHAR)"
_Row = tuple[str, str, str, str, str, str]


def _plain(name: str, version: str, direct: str = "true", resolved: str = "false") -> _Row:
    return (name, version, _NONE, "'notinformat'", direct, resolved)


FORMATS: dict[str, tuple[str, str, str, list[_Row]]] = {
    "npm": ("package-lock.json", "npm", _NPM, [
        (NAME, VER, LICENCE, _ABSENT, "true", "true"),
        (BRAND, "'9'", _NONE, "'absent'", "false", "true"),
    ]),
    "npm_nested": ("npm-shrinkwrap.json", "npm", _NPM_OLD, [
        (NAME, VER, _NONE, "'absent'", "true", "true"),
        (BRAND, "'3'", _NONE, "'absent'", "false", "true"),
    ]),
    "cargo_lock": ("Cargo.lock", "cargo", _CARGO_LOCK, [
        _plain(NAME, VER, "true", "true"), _plain(BRAND, "''", "false", "true"),
    ]),
    "cargo": ("Cargo.toml", "cargo", _CARGO_TOML, [
        (NAME, VER, LICENCE, _ABSENT, "true", "false"),
        (BRAND, "'^2'", _NONE, "'absent'", "true", "false"),
    ]),
    "requirements": ("requirements.txt", "pypi", _REQUIREMENTS, [
        _plain(NAME, VER), _plain(BRAND, "'>=2, <3'"),
    ]),
    "pyproject": ("pyproject.toml", "pypi", _PYPROJECT, [
        _plain(NAME, f"'~=' || {VER}"), (BRAND, "'*'", _NONE, "'absent'", "true", "false"),
    ]),
    "poetry": ("poetry.lock", "pypi", _POETRY_LOCK, [
        (NAME, VER, LICENCE, _ABSENT, "p_partkey % 2 <> 0", "true"),
    ]),
    "gomod": ("go.mod", "go", _GO_MOD, [
        _plain(NAME, f"'v' || {VER}"), _plain(BRAND, "'v1'", "false"),
        _plain("'z' || p_size", "'v2'"),
    ]),
    "composer": ("composer.lock", "composer", _COMPOSER, [
        (NAME, VER, LICENCE, _ABSENT, "true", "true"),
        (BRAND, "''", _NONE, "'absent'", "false", "true"),
    ]),
    "gemfile": ("Gemfile.lock", "rubygems", _GEMFILE, [
        _plain(NAME, VER, "true", "true"), _plain(BRAND, "'>= 1'", "false", "true"),
    ]),
}
_ORDER = ["npm", "npm_nested", "cargo_lock", "cargo", "gemfile", "composer", "poetry",
          "pyproject", "requirements", "gomod"]


def _path(base: str) -> str:
    return f"'pkg/' || p_partkey || '/{base}'"


def _sql_rows(fmt: str, extra: str = "") -> str:
    base, eco, _, rows = FORMATS[fmt]
    return " UNION ALL ".join(
        f"SELECT {n} AS name, {v} AS version, '{eco}' AS ecosystem, {lic} AS license, "
        f"{av} AS licence_availability, {_path(base)} AS manifest, {d} AS direct, {r} AS resolved"
        f"{extra.format(seq=i, cand=_ORDER.index(fmt))} FROM part"
        for i, (n, v, lic, av, d, r) in enumerate(rows)
    )


def manifests(spark: SparkSession, d: str, *formats: str) -> DataFrame:
    part = spread(R.table(spark, d, "part"))
    texts = [
        F.struct(F.expr(_path(FORMATS[f][0])).alias("path"), F.expr(FORMATS[f][2]).alias("text"))
        for f in formats
    ]
    return part.select(F.inline(F.array(*texts)))


def _inventory_query(fmt: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return parse_manifests(manifests(spark, d, fmt)).select(*DEPENDENCY_COLUMNS)

    return run


for _fmt in FORMATS:
    query(f"inventory_{_fmt}", _sql_rows(_fmt))(_inventory_query(_fmt))

_ALL_ROWS = " UNION ALL ".join(
    f"({_sql_rows(f, ', {cand} AS cand, {seq} AS seq')})" for f in FORMATS
)
_KEY = "(cand, manifest, seq)"
_MERGED = f"""(SELECT name, ecosystem,
  coalesce(arg_min(version, {_KEY}) FILTER (resolved),
           arg_min(version, {_KEY}) FILTER (version <> ''), '') AS version,
  arg_min(license, {_KEY}) FILTER (license IS NOT NULL) AS license,
  CASE max(CASE licence_availability WHEN 'declared' THEN 3 WHEN 'absent' THEN 2 ELSE 1 END)
    WHEN 3 THEN 'declared' WHEN 2 THEN 'absent' ELSE 'notinformat' END AS licence_availability,
  arg_min(manifest, {_KEY}) AS manifest, bool_or(direct) AS direct, bool_or(resolved) AS resolved
FROM ({_ALL_ROWS}) GROUP BY name, ecosystem)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return merge_inventory(parse_manifests(manifests(spark, d, *FORMATS)))


@query("inventory_merge", f"SELECT * FROM {_MERGED}")
def inventory_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query(
    "inventory_ordered",
    f"""SELECT row_number() OVER (ORDER BY list_position([{', '.join(f"'{e}'" for e in ECOSYSTEMS)}], ecosystem), name)
      - 1 AS place, ecosystem, name, version FROM {_MERGED}""",
)
def inventory_ordered(spark: SparkSession, d: str) -> DataFrame:
    return R.placed(inventory_order(_merged(spark, d))).select("place", "ecosystem", "name", "version")


POLICY = Policy(allow=("MIT", "Apache-2.0"), deny=("GPL-3.0",), scope="all")


def _verdict_sql(source: str) -> str:
    one = (
        "lambda c: CASE WHEN lower(trim(c)) IN ('gpl-3.0') THEN 4 "
        "WHEN lower(trim(c)) IN ('mit', 'apache-2.0') THEN 1 "
        "WHEN lower(trim(c)) IN ('lgpl-3.0') THEN 2 ELSE 3 END"
    )
    split = (
        "CASE WHEN contains(license, ' OR ') THEN string_split(license, ' OR ') "
        "ELSE string_split(license, '/') END"
    )
    return f"""(SELECT name AS package, version, ecosystem,
      CASE WHEN licence_availability = 'notinformat' THEN 'not in this manifest format'
           WHEN license IS NULL THEN 'none declared' ELSE license END AS licence,
      CASE WHEN licence_availability = 'notinformat' THEN 'unavailable'
           WHEN license IS NULL THEN 'unlicensed'
           ELSE (['allowed', 'unlisted', 'unknown', 'denied'])[list_min(list_transform({split}, {one}))]
      END AS verdict, direct, manifest FROM {source})"""


_UNMERGED = f"({_sql_rows('npm')})"


@query("licence_verdicts", f"SELECT * FROM {_verdict_sql(_UNMERGED)}")
def licence_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of every manifest row, before merging: all licence forms occur."""
    return licence_findings(parse_manifests(manifests(spark, d, "npm")), POLICY)


@query(
    "licence_summary",
    f"""SELECT verdict, count(*) AS n, verdict NOT IN ('allowed', 'unavailable') AS problem
    FROM {_verdict_sql(_MERGED)} WHERE direct GROUP BY 1""",
)
def licence_counts(spark: SparkSession, d: str) -> DataFrame:
    policy = Policy(allow=POLICY.allow, deny=POLICY.deny)
    return licence_summary(licence_findings(_merged(spark, d), policy))


@query(
    "licence_problems",
    f"""SELECT ecosystem, count(*) AS checked,
      count(*) FILTER (verdict NOT IN ('allowed', 'unavailable')) AS problems
    FROM {_verdict_sql(_MERGED)} WHERE verdict <> 'unlicensed' GROUP BY 1""",
)
def licence_problems(spark: SparkSession, d: str) -> DataFrame:
    """Gate counts under a policy that leaves packages without a licence out."""
    policy = Policy(POLICY.allow, POLICY.deny, unlicensed="ignore", scope="all")
    found = licence_findings(_merged(spark, d), policy)
    return found.groupBy("ecosystem").agg(
        F.count("*").alias("checked"),
        F.count(F.when(is_problem(F.col("verdict")), 1)).alias("problems"),
    )


_NAMED = C.SQL_TEXT_RULES[2]


@query(
    "licence_lines_in_documents",
    f"""SELECT licence, verdict, count(*) AS n FROM (
      SELECT CASE WHEN contains(snippet, 'MIT License') THEN 'MIT'
                  WHEN contains(snippet, 'Apache License') THEN 'Apache-2.0'
                  WHEN contains(snippet, 'GNU General Public') THEN 'GPL-3.0'
                  WHEN contains(snippet, 'CC BY-NC') THEN 'CC-BY-NC-4.0' ELSE 'other' END AS licence
      FROM {SQL_DOC_FINDINGS} WHERE rule_id = 'licence-notice'),
      (VALUES ('MIT', 'allowed'), ('Apache-2.0', 'allowed'), ('GPL-3.0', 'denied'),
              ('CC-BY-NC-4.0', 'unlisted'), ('other', 'unknown')) v(l, verdict)
    WHERE l = licence GROUP BY ALL""",
)
def licence_lines_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Licence notices found in texts, judged by the policy."""
    from tamis.operators.licences import judge_licence

    found = raw_findings(R.documents(spark, d), [C.LICENCE])
    has = lambda s: F.contains("snippet", F.lit(s))
    licence = (
        F.when(has("MIT License"), "MIT")
        .when(has("Apache License"), "Apache-2.0")
        .when(has("GNU General Public"), "GPL-3.0")
        .when(has("CC BY-NC"), "CC-BY-NC-4.0")
        .otherwise("other")
    )
    return (
        found.select(licence.alias("licence"))
        .withColumn("verdict", judge_licence(F.col("licence"), POLICY))
        .groupBy("licence", "verdict")
        .agg(F.count("*").alias("n"))
    )


# -- look-alikes -------------------------------------------------------------

# Names made from part keys: changed, decorated and unrelated ones. Each holds
# its key only where the change leaves room for it.
_LISTED = ["requests", "numpy", "pandas", "django", "matplotlib", "python-dateutil", "flask"]
_BASE = "CASE p_partkey % 7 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(_LISTED)
) + " END"
_AT = "(p_size % 5 + 1)"
_LOOK = f"""CASE p_size % 9
  WHEN 0 THEN {_BASE}
  WHEN 1 THEN upper({_BASE})
  WHEN 2 THEN substr({_BASE}, 1, {_AT} - 1) || substr({_BASE}, {_AT} + 1)
  WHEN 3 THEN substr({_BASE}, 1, {_AT}) || 'q' || substr({_BASE}, {_AT} + 1)
  WHEN 4 THEN substr({_BASE}, 1, {_AT} - 1) || 'x' || substr({_BASE}, {_AT} + 1)
  WHEN 5 THEN {_BASE} || '-secure'
  WHEN 6 THEN replace(replace({_BASE}, 'e', '3'), 'a', '4')
  WHEN 7 THEN substr({_BASE}, 1, 2) || '_' || substr({_BASE}, 3)
  ELSE 'own-' || {NAME} END"""


def _known_values() -> str:
    return ", ".join(f"('{n}', {i})" for i, n in enumerate(_LISTED))


# All pairs with a full edit-distance table: independent of key look-up.
_SUSPECTS = f"""(SELECT name AS package, 'pypi' AS ecosystem, version,
    arg_min(known, (score, rank)) AS impersonates, arg_min(signal, (score, rank)) AS signal,
    CAST(min(score) AS INT) AS score
  FROM (
    SELECT *, CASE WHEN n = k THEN 3 WHEN affix THEN 1
        WHEN folded = k AND length(k) >= 4 THEN 2
        WHEN dist <= CASE WHEN length(k) >= 8 THEN 2 ELSE 1 END THEN 4 + dist END AS score,
      CASE WHEN n = k THEN 'separator-only variant' WHEN affix THEN 'real name plus ''secure'''
        WHEN folded = k AND length(k) >= 4 THEN 'character substitution'
        ELSE 'edit-distance ' || dist END AS signal
    FROM (
      SELECT *, n = k || 'secure' AS affix, damerau_levenshtein(n, k) AS dist,
        translate(replace(replace(n, 'rn', 'm'), 'cl', 'd'), '0134578', 'oleastb') AS folded
      FROM (
        SELECT name, version, known, rank, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS n,
          lower(regexp_replace(known, '[^a-zA-Z0-9]', '', 'g')) AS k
        FROM (SELECT {_LOOK} AS name, min('1') AS version FROM part GROUP BY 1),
             (VALUES {_known_values()}) v(known, rank))))
  GROUP BY name, version
  HAVING min(score) IS NOT NULL AND NOT bool_or(lower(known) = lower(name)))"""


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    names = R.table(spark, d, "part").selectExpr(
        f"{_LOOK} AS name", "'1' AS version", "'pypi' AS ecosystem"
    )
    return lookalikes(names, known_names(spark, {"pypi": _LISTED}))


@query(
    "typosquat",
    f"SELECT package, ecosystem, version, impersonates, signal, score FROM {_SUSPECTS}",
)
def typosquat(spark: SparkSession, d: str) -> DataFrame:
    return _suspects(spark, d)


@query(
    "typosquat_by_ecosystem",
    f"SELECT ecosystem, count(*) AS suspects, min(score) AS worst_score FROM {_SUSPECTS} GROUP BY 1",
)
def typosquat_by_ecosystem(spark: SparkSession, d: str) -> DataFrame:
    return suspects_by_ecosystem(_suspects(spark, d))

