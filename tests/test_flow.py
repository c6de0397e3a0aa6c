import pytest

from tamis.plans.scan import raw_findings
from tamis.sources.rules import Flow, Rule

FLOW = Flow(("request.$ANY", "read()"), ("execute(...)", "eval(...)"), ("clean(...)",))

CASES = {
    "direct.py": ("q = request.args['q']\nexecute(q)", [2]),
    "sanitized.py": ("q = request.args['q']\nq = clean(q)\nexecute(q)", []),
    "source on the sink line.py": ("execute(request.x)", [1]),
    "comment.py": ("q = read()\n# execute(q)\n// execute(q)", []),
    "propagates.py": ("q = read()\nw = 'a' + q\nexecute(w)", [3]),
    "reassigned stays.py": ("q = read()\nq = 1\nexecute(q)", [3]),
    "suffix.py": ("q = read()\nexecute(xq)", [2]),
    "dotted clean is no plain assignment.py": ("a.b = read()\na.b = clean(1)\nexecute(b)", [3]),
    "sink on a cleaning line.py": ("q = read()\nexecute(clean(q))", []),
    "parameter.py": ("def run(q):\n    execute(q)\n", [2]),
    "self is no parameter.py": ("def run(self):\n    execute(self)\n", []),
    "summary.py": ("def get():\n    return request.x\n\nv = get()\nexecute(v)", [5]),
    "summary of a clean function.py": ("def get():\n    return 1\n\nv = get()\nexecute(v)", []),
    "summary with argument.py": ("def get(a):\n    return a\n\nv = o.get(1)\nexecute(v)", []),
    "tainted argument.py": ("def get(a):\n    return a\nx = read()\nv = o.get(x)\nexecute(v)", [5]),
    "scopes are apart.py": ("def f():\n    q = read()\n\nexecute(q)", []),
    "one level only.py": (
        "def a():\n    return read()\ndef b():\n    return a()\nx = b()\nexecute(x)", []),
    "braces.js": ("function h(q) {\n  eval(q)\n}\n", [2]),
    "control words open no function.js": ("if (q) {\n  eval(q)\n}\n", []),
    "nested braces.js": ("function h(q) {\n if (q) {\n  eval(q)\n }\n}\neval(q)", [3]),
    "both kinds.txt": ("def f(a):\n    execute(a)\nfunction g(b) {\n  eval(b)\n}\n", [2, 4]),
    "open at the end.js": ("function h(q) {\n  eval(q)", [2]),
    "ruby without parentheses.rb": ("def f\n  execute(q)\nend\nq = read()\nexecute(q)", [5]),
}


@pytest.fixture(scope="module")
def found(spark):
    from pyspark.sql import functions as F

    from tamis.sources.files import from_table

    df = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()], "p string, t string")
    rule = Rule("flow", ("generic",), "ERROR", "m", flow=FLOW)
    out = {}
    for r in raw_findings(from_table(df, F.col("p"), F.col("t")), [rule]).collect():
        out.setdefault(r.path, []).append(r.line)
        assert r.col == 0
    return out


@pytest.mark.parametrize("path", CASES)
def test_flow(found, path):
    assert sorted(found.get(path, [])) == CASES[path][1]


def test_snippet_keeps_the_indent(files):
    f = files(("a.py", "def run(q):\n    execute(q)\n"))
    rule = Rule("flow", ("python",), "ERROR", "m", flow=FLOW)
    assert raw_findings(f, [rule]).first().snippet == "    execute(q)"


def test_empty_roles(files):
    f = files(("a.py", "q = read()\nexecute(q)"))
    no_sink = Rule("a", ("python",), "ERROR", "m", flow=Flow(("read()",), ()))
    no_source = Rule("b", ("python",), "ERROR", "m", flow=Flow((), ("execute(...)",)))
    assert raw_findings(f, [no_sink, no_source]).count() == 0


SKIPS = {
    "leak reaches a function.py": (
        "def get(a):\n    return a\ndef use():\n    v = get()\n    execute(v)\ndef own(q):\n    execute(q)\n", [5, 7]),
    "source only inside.py": ("def f():\n    q = read()\nexecute(q)\n", []),
    "sink only inside.py": ("q = read()\ndef f(a):\n    execute(a)\n", [3]),
    "leak without a sink on top.py": ("def get():\n    return read()\ndef f():\n    execute(get())\nget()", [4]),
    "no source but a leak.js": ("function get(a) {\n  return a;\n}\nv = get();\nexecute(v);\n", [5]),
    "white space around.py": ("　q = read()\t\r\n execute(q)\r\n", [2]),
}


def test_flows_skip_only_what_cannot_change(spark):
    """Functions are found by one fold of each kind, and skipped folds lose nothing."""
    from pyspark.sql import functions as F

    from tamis.operators.flow import flow_lines
    from tamis.sources.files import from_table

    df = from_table(
        spark.createDataFrame([(p, t) for p, (t, _) in SKIPS.items()], "p string, t string"), F.col("p"), F.col("t")
    )
    regexes = [F.lit(r) for r in (r"read\(\)", r"execute\(.*?\)", r"clean\(.*?\)")]
    got = df.select("path", flow_lines(F.col("text"), F.col("lang"), *regexes).alias("at"))
    assert {r.path: r["at"] for r in got.collect()} == {p: at for p, (_, at) in SKIPS.items()}
    # two kinds of functions, a function alone and again, and the top level
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 5
