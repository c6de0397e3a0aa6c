import pytest
from pyspark.sql import functions as F

from tamis.operators.inventory import inventory, parse_manifests, unreadable_manifests
from tamis.operators.licences import licence_findings, licence_order, licence_summary
from tamis.operators.lookalikes import edit_distance, known_names, lookalikes, suspect_order
from tamis.plans.supply_chain import collect_inventory, licence_report
from tamis.sources.policy import Policy, load_policy, parse_policy

MANIFESTS = {
    "Cargo.lock": (
        '[[package]]\nname = "me"\ndependencies = ["serde 1.0", "tokio"]\n'
        '[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "r"\n'
        '[[package]]\nname = "libc"\nversion = "0.2"\nsource = "r"\n',
        [("serde", "1.0.1", None, True), ("libc", "0.2", None, False)],
    ),
    "Cargo.toml": (
        '[dependencies]\nserde = "1"\ntokio = {version = "1", license = "MIT"}\n'
        '[workspace.dependencies]\nno = "1"\n[dev-dependencies]\nserde = "2"\n'
        "[target.'cfg(unix)'.dependencies]\nnix = {path = 'x'}\n[build-dependencies]\ncc = 5\n",
        [("serde", "1", None, True), ("tokio", "1", "MIT", True), ("cc", "", None, True),
         ("nix", "", None, True)],
    ),
    "package-lock.json": (
        '{"packages": {"": {"dependencies": {"debug": "1"}, "devDependencies": {"a": "1"}},'
        '"node_modules/debug": {"version": "3"}, "node_modules/a": {"version": "1", "license": ["MIT"]},'
        '"node_modules/a/node_modules/debug": {"version": "2"}, "node_modules/": {}}}',
        [("a", "1", None, False), ("debug", "2", None, False)],
    ),
    "npm-shrinkwrap.json": (
        '{"dependencies": {"x": {"version": "1", "license": "ISC", "dependencies":'
        ' {"y": {"version": "2"}, "x": {"version": "0"}}}}}',
        [("x", "1", "ISC", True), ("y", "2", None, False)],
    ),
    "requirements.txt": (
        "# c\nflask==2.0  # why\nuvicorn[standard]>=0.1 ; python_version > '3'\nbare\n-e .\n"
        "git+https://h/x\nh==1 --hash=sha256:aa\nflask==9\n==3\n",
        [("flask", "2.0", None, True), ("uvicorn", ">=0.1", None, True), ("bare", "", None, True),
         ("h", "1", None, True)],
    ),
    "pyproject.toml": (
        '[project]\ndependencies = ["requests[socks]>=2; python_version > \'3\'", "click"]\n'
        '[tool.poetry.dependencies]\nPython = "^3"\ndjango = {version = "4", license = "BSD"}\n',
        [("requests", ">=2", None, True), ("click", "", None, True), ("django", "4", "BSD", True)],
    ),
    "poetry.lock": (
        '[[package]]\nname = "p"\nversion = "1"\ncategory = "DEV"\nlicense = "MIT"\n'
        '[[package]]\nname = "q"\n[[package]]\nname = "q"\n',
        [("p", "1", "MIT", False), ("q", "", None, True), ("q", "", None, True)],
    ),
    "go.mod": (
        "module x\nrequire (\n\ta.b/c v1.0.0\n\td.e/f v2 // indirect\n\tlonely\n)\n"
        "require g.h/i v3\nreplace z => y v9\n",
        [("a.b/c", "v1.0.0", None, True), ("d.e/f", "v2", None, False), ("g.h/i", "v3", None, True)],
    ),
    "composer.lock": (
        '{"packages": [{"name": "a/b", "version": "1", "license": ["MIT", "X"]}],'
        '"packages-dev": [{"name": "c/d", "license": "GPL-3.0"}, {"version": "2"}]}',
        [("a/b", "1", "MIT", True), ("c/d", "", "GPL-3.0", False)],
    ),
    "Gemfile.lock": (
        "GIT\n  remote: x\n  specs:\n    own (1)\n\nGEM\n  remote: https://h/\n  specs:\n"
        "    rails (7.0.0.beta-1)\n      rack (>= 2)\n    noko (1.1-x86_64-linux-musl)\n\n"
        "PLATFORMS\n  ruby\n\nDEPENDENCIES\n  noko!\n  rails (= 7)\n  !odd\n",
        [("rails", "7.0.0.beta-1", None, True), ("rack", ">= 2", None, False),
         ("noko", "1.1", None, True)],
    ),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f"x/{name}", text) for name, (text, _) in MANIFESTS.items()]
    rows += [(f"bad/{name}", "{[ not: valid" ) for name in MANIFESTS if name.endswith((".json", ".lock", ".toml"))]
    rows += [("x/go.sum", "a v1 h1:x"), ("x/CARGO.TOML", '[dependencies]\na = "1"'), ("x/null.json", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    out = {}
    for r in parse_manifests(df).orderBy("manifest", "seq").collect():
        out.setdefault(r.manifest, []).append((r.name, r.version, r.license, r.direct))
    return out


@pytest.mark.parametrize("name", MANIFESTS)
def test_formats(parsed, name):
    assert parsed[f"x/{name}"] == MANIFESTS[name][1]


def test_malformed_and_unknown_files_give_nothing(parsed):
    assert not [p for p in parsed if p.startswith("bad/")]
    assert set(parsed) == {f"x/{n}" for n in MANIFESTS}


def test_merge(spark):
    rows = [
        ("a/Cargo.toml", '[dependencies]\nserde = {version = "1", license = "MIT"}\nrand = "0.8"\n'),
        ("a/Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.9"\nsource = "r"\n'),
        ("b/requirements.txt", "serde==9\n"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {(r.ecosystem, r.name): r for r in inventory(df).collect()}
    serde = got["cargo", "serde"]
    assert (serde.version, serde.license, serde.licence_availability) == ("1.0.9", "MIT", "declared")
    assert serde.direct and serde.resolved and serde.manifest == "a/Cargo.lock"
    assert got["cargo", "rand"].version == "0.8" and got["pypi", "serde"].version == "9"


def deps(spark, *rows):
    return spark.createDataFrame(
        [(f"p{i}", "1", "npm", lic, av, "m", direct, True) for i, (lic, av, direct) in enumerate(rows)],
        "name string, version string, ecosystem string, license string, "
        "licence_availability string, manifest string, direct boolean, resolved boolean",
    )


@pytest.mark.parametrize(
    "licence, verdict",
    [
        ("MIT", "allowed"), ("mit", "allowed"), ("GPL-3.0", "denied"), ("MIT OR GPL-3.0", "allowed"),
        ("GPL-3.0 OR LGPL-3.0", "unlisted"), ("GPL-3.0/odd", "unknown"), ("https://x/y", "unknown"),
        ("LGPL-2.1", "unlisted"), ("MIIT", "unknown"), ("  MIT\n", "allowed"), ("GPL-3.0 OR gpl-3.0", "denied"),
    ],
)
def test_verdicts(spark, licence, verdict):
    policy = Policy(allow=("MIT",), deny=("GPL-3.0",))
    found = licence_findings(deps(spark, (licence, "declared", True)), policy)
    assert found.first().verdict == verdict


def test_scope_and_missing_licences(spark):
    rows = deps(spark, (None, "absent", True), (None, "notinformat", True), ("MIT", "declared", False))
    verdicts = lambda p: sorted(r.verdict for r in licence_findings(rows, p).collect())
    assert verdicts(Policy()) == ["unavailable", "unlicensed"]
    assert verdicts(Policy(unlicensed="ignore")) == ["unavailable"]
    assert verdicts(Policy(scope="all")) == ["unavailable", "unlicensed", "unlisted"]
    ordered = licence_order(licence_findings(rows, Policy(scope="all"))).collect()
    assert [r.verdict for r in ordered] == ["unlicensed", "unlisted", "unavailable"]
    assert {r.verdict: r.problem for r in licence_summary(licence_findings(rows, Policy())).collect()} == {
        "unlicensed": True, "unavailable": False,
    }


def test_policy_files(tmp_path):
    assert parse_policy("allow: [' MIT  X ', 3]\nscope: ALL\nunlicensed: Error\nnew: 1") == Policy(
        ("MIT X",), (), "error", "all"
    )
    assert parse_policy("a: [") == parse_policy("text") == load_policy(str(tmp_path)) == Policy()
    with pytest.raises(FileNotFoundError):
        load_policy(str(tmp_path), str(tmp_path / "none.yml"))


SUSPECTS = {
    "reqeusts": ("requests", "edit-distance 1", 5), "requsts": ("requests", "edit-distance 1", 5),
    "requestsxy": ("requests", "edit-distance 2", 6), "requests-secure": ("requests", "real name plus 'secure'", 1),
    "numpycopy": ("numpy", "real name plus 'copy'", 1), "f1ask": ("flask", "character substitution", 2),
    "p4nd45": ("pandas", "character substitution", 2), "python_dateutil": ("python-dateutil", "separator-only variant", 3),
    "nupmy": ("numpy", "edit-distance 1", 5), "click": None, "Requests": None, "internal-tool": None,
    "nump": ("numpy", "edit-distance 1", 5), "nuxpxy": None, "--": None,
}


def test_lookalikes(spark):
    rows = spark.createDataFrame([(n, "1", "pypi") for n in SUSPECTS], "name string, version string, ecosystem string")
    got = {r.package: (r.impersonates, r.signal, r.score) for r in lookalikes(rows).collect()}
    assert got == {n: s for n, s in SUSPECTS.items() if s}
    again = [tuple(r) for r in suspect_order(lookalikes(rows.repartition(3))).collect()]
    assert again == [tuple(r) for r in suspect_order(lookalikes(rows)).collect()]
    other = rows.withColumn("ecosystem", F.lit("go"))
    assert lookalikes(other, known_names(spark, {"pypi": ["requests"]})).count() == 0


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance_and_key_join_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 10))) for _ in range(60)] + ["ca", "abc"]
    pairs = list(itertools.product(words[:30], words[30:]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(a, b, osa(a, b)) for a, b in pairs]

    listed = [w for w in dict.fromkeys(words[30:]) if w]
    names = spark.createDataFrame([(w, "1", "npm") for w in set(words[:30]) if w], "name string, version string, ecosystem string")
    found = {
        r.package: (r.impersonates, r.score)
        for r in lookalikes(names, known_names(spark, {"npm": listed})).collect()
        if r.score > 4
    }
    want = {}
    for w in set(words[:30]) - set(listed) - {""}:
        near = [(4 + osa(w, c), i, c) for i, c in enumerate(listed) if osa(w, c) <= (2 if len(c) >= 8 else 1)]
        if near:
            want[w] = (min(near)[2], min(near)[0])
    assert found == want


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/requirements.txt").write_text("flask==1\n")
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = {version="1", license="GPL-3.0"}\n')
    (tmp_path / ".tamis-licences.yml").write_text("deny: [gpl-3.0]\n")
    rows = collect_inventory(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.manifest) for r in rows] == [("flask", "sub/requirements.txt"), ("serde", "Cargo.toml")]
    found, problems = licence_report(spark, str(tmp_path))
    assert found.count() == 2 and problems.first().package == "serde"


def test_repeated_keys_and_unreadable_manifests(files):
    lock = '{"name": "x", "name": "y", "packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "0"}, "node_modules/a": {"version": "1"}}}'
    composer = '{"packages": [{"name": "p/q", "version": "1", "version": "2"}]}'
    f = files(("package-lock.json", lock), ("x/composer.lock", composer), ("y/Cargo.lock", "= bad"), ("z/composer.lock", "{"))
    found = {(r["name"], r["version"], r["direct"]) for r in inventory(f).collect()}
    assert found == {("a", "1", True), ("p/q", "2", True)}
    assert sorted(r[0] for r in unreadable_manifests(f).collect()) == ["y/Cargo.lock", "z/composer.lock"]


def test_one_arrow_pass_reads_every_format(files):
    """The old npm layout had a pass of its own."""
    from tamis.operators.inventory import parse_manifests

    plan = parse_manifests(files(("a/package-lock.json", "{}")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


STATEMENTS = [
    "[a]", "[a.b]", "[a.b.c]", "[[a]]", "[[p]]", "[ a ]", "[a..b]", "[.a]", "[]", '["a"]', 'a = "x"', 'b="é"', '"a" = "y"',
    '"" = "z"', 'a.b = "1"', "a = 'x'", 'b = """x"""', 'c = ["a","b"]', 'c = [\n "a",\n "b",\n]', 'c = ["a" "b"]', "c=[]",
    "c = [,]", 'd = {a="1", b = "2"}', 'd = {a="1", a = "2"}', "d = {}", 'd = {a="1",}', "e = 3", "e = 03", "e = 1.5",
    "e = true", "f = 1979-05-27", "# c", 'a = "x" # c', 'a = "x" y', "a =", "", '\ta = "t\tt"', 'a = "q\\"q"', 'a = "x"\r', "# \x01",
]


def test_toml_of_plain_lines_is_what_the_library_reads():
    import random
    import tomllib

    from tamis.operators.inventory import _toml_of_plain_lines

    read, rnd, accepted = _toml_of_plain_lines(), random.Random(1), 0
    for _ in range(20_000):
        text = "".join(rnd.choice(STATEMENTS) + rnd.choice(["\n", "\n", "\n\n", "\r\n"]) for _ in range(rnd.randint(1, 4)))
        found = read(text)
        if found is not None:  # else the library reads it
            accepted += 1
            assert found == tomllib.loads(text), text
    assert accepted > 2000
    lock = '# made\nversion = 4\n' + '[[package]]\nname = "a"\nsource = "r"\ndependencies = [\n "b 1",\n]\n\n' * 3
    assert read(lock) == tomllib.loads(lock)
    for base in ("Cargo.lock", "poetry.lock", "Cargo.toml"):
        plain = [text for name, (text, _) in MANIFESTS.items() if name == base and "'" not in text and "= 5" not in text]
        assert all(read(text) == tomllib.loads(text) for text in plain)
    assert read("[" + "a." * 50_000 + "a]") is None


def test_parts_between_matches(spark):
    """Also where the text has the letter that stands for a match."""
    from tamis.functions.text import split_on

    texts = ["", "a", " a  b\n c ", "a　b", "﷑ a ﷑", "\n\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for regex in (r"(?U)\s+", r"(?U)\n(?!\s)", r"\n(?=\s)"):
        assert all(r[0] == r[1] for r in df.select(split_on(F.col("t"), regex), F.split("t", regex, -1)).collect())


def test_words_of_manifests_compile_no_regex_a_line(files):
    """``split`` compiles its regex on each call: lines are split by a letter."""
    import re

    from tamis.operators.inventory import parse_manifests

    plan = parse_manifests(files(("a/go.mod", "")))._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"split\([^()]*, node_modules/", plan) and "regexp_replace" in plan
    assert plan.count("﷑") >= 4
