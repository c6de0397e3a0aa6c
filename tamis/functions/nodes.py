"""Syntax-tree nodes held as a table (one row per node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import trim_ws

# Grammar node kinds per normalised kind.
KINDS = {
    "call": ("call_expression", "call"),
    "function": (
        "function_definition", "function_declaration", "function",
        "method_definition", "func_declaration",
    ),
    "string": ("string", "string_literal", "interpreted_string_literal"),
    "identifier": ("identifier", "field_identifier", "name"),
    "import": ("import_statement", "import_declaration", "import"),
    "if": ("if_statement",),
    "loop": ("for_statement", "while_statement", "for_clause"),
    "return": ("return_statement",),
    "assign": (
        "assignment_expression", "assignment_statement", "short_var_declaration",
        "expression_statement",
    ),
}


def normalise_kind(grammar_kind: Column) -> Column:
    out = F
    for kind, names in KINDS.items():
        out = out.when(grammar_kind.isin(*names), F.lit(kind))
    return out.otherwise(F.concat(F.lit("other:"), grammar_kind))


def node_snippet(text: Column, chars: int) -> Column:
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def callees(nodes: DataFrame) -> DataFrame:
    """Called names of a node table with the columns kind and text."""
    name = trim_ws(F.substring_index("text", "(", 1))
    return (
        nodes.filter(F.col("kind") == "call")
        .withColumn("callee", name)
        .filter("callee <> ''")
    )
