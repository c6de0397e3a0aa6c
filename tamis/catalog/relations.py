"""File and manifest relations made from the tables.

The column expressions are plain SQL that Spark and other engines read alike,
so a query and its SQL counterpart start from the same rows. Every row of a
table becomes one file; nothing is grouped to build texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.plans.settle import settled
from tamis.sources.files import from_table, spread

DOC_PATH = "'docs/' || source || '/' || doc_id || '.txt'"
PAGE_PATH = "'site/' || page_id || '.html'"
CONV_PATH = "'conv/' || conv_id || '/' || turn || '.md'"

_QTY = "CAST(l_quantity AS INT)"
_NL = " || chr(10) || "
_ROW_KEY = (
    f"l_orderkey || '/' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || {_QTY}"
    " || '_' || l_returnflag || l_linestatus"
)
CODE_EXT = (
    "CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' ELSE '.inc' END"
)
CODE_LANG = (
    "CASE l_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' "
    "ELSE 'generic' END"
)
CODE_PATH = f"'src/' || {_ROW_KEY} || {CODE_EXT}"
# A straight-line program per line item: read, derive, use.
CODE_TEXT = _NL.join(
    [
        "'import os'",
        "'v' || l_partkey || CASE WHEN l_returnflag = 'R' THEN ' = load_config()' "
        "ELSE ' = read_input()' END",
        "CASE WHEN l_linestatus = 'F' THEN 'w = v' || l_partkey || ' + \"x\"' "
        "ELSE 'w = escape(v' || l_partkey || ')' END",
        f"CASE WHEN l_linenumber % 2 = 1 THEN 'run_cmd(w)' ELSE 'log(w, ' || {_QTY} || ')' END",
        "CASE WHEN l_suppkey % 5 = 0 THEN '# tamis-ignore-next-line' ELSE 'pass' END",
        f"'run_cmd(v' || l_partkey || ', ' || {_QTY} || ')'",
        "''",
    ]
)
FUNC_PATH = f"'lib/' || {_ROW_KEY} || '.py'"
# The same with a function whose result may or may not be tainted.
FUNC_TEXT = _NL.join(
    [
        "'def load' || l_partkey || '(name):'",
        "CASE WHEN l_linestatus = 'F' THEN '    return name + \"s\"' ELSE '    return \"s\"' END",
        "''",
        "'x = load' || l_partkey || '()'",
        "CASE WHEN l_returnflag = 'A' THEN 'x = escape(x)' ELSE 'pass' END",
        "'run_cmd(x)'",
        "''",
    ]
)

BRACE_PATH = f"'lib/' || {_ROW_KEY} || '.js'"
# The same in a language whose functions are told by braces.
BRACE_TEXT = _NL.join(
    [
        "'function load' || l_partkey || '(name) {'",
        "CASE WHEN l_linestatus = 'F' THEN '  return name + \"s\";' ELSE '  return \"s\";' END",
        "'}'",
        "'x = load' || l_partkey || '();'",
        "CASE WHEN l_returnflag = 'A' THEN 'x = escape(x);' ELSE ';' END",
        "'run_cmd(x);'",
        "''",
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, path: str, text: str, *keep: str) -> DataFrame:
    return from_table(spread(df), F.expr(path), F.expr(text), *keep)


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return _files(table(spark, sf_dir, "documents"), DOC_PATH, "text", *keep)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "pages"), PAGE_PATH, "html")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "conversations"), CONV_PATH, "text")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "lineitem"), CODE_PATH, CODE_TEXT)


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "lineitem"), FUNC_PATH, FUNC_TEXT)


def brace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "lineitem"), BRACE_PATH, BRACE_TEXT)


def sql_files(path: str, text: str, source: str, lang: str = "'generic'", keep: str = "") -> str:
    return f"(SELECT {keep}{path} AS path, {text} AS text, {lang} AS language FROM {source})"


SQL_DOCUMENTS = sql_files(DOC_PATH, "text", "documents")
SQL_PAGES = sql_files(PAGE_PATH, "html", "pages", "'html'")
SQL_CONVERSATIONS = sql_files(CONV_PATH, "text", "conversations")
SQL_CODE = sql_files(CODE_PATH, CODE_TEXT, "lineitem", CODE_LANG)


def placed(rows: DataFrame) -> DataFrame:
    """Rows with the place they have in their order: the partition's first
    place, from one count per partition, and the place within it."""
    rows = settled(rows)
    numbered = rows.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()})
    counts = {r[0]: r[1] for r in numbered.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(F.lit(total))
        total += counts.get(part, 0)
    first = F.get(F.array(*before), F.col("_part")) if before else F.lit(0)
    within = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("place", (first + within).cast("bigint"))
