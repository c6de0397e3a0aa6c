"""Dependency inventory: manifest texts to one row per package.

JSON manifests are read as VARIANT, line formats with string functions. TOML
has no reader in Spark, so one small Arrow UDF turns it into JSON first.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.text import UNICODE, WS, basename, let, lines, split_on, trim_ws

# Manifest names in look-up order and their ecosystem. The order
# decides which manifest a merged package is first seen in.
MANIFESTS = {
    "package-lock.json": "npm",
    "npm-shrinkwrap.json": "npm",
    "Cargo.lock": "cargo",
    "Cargo.toml": "cargo",
    "Gemfile.lock": "rubygems",
    "composer.lock": "composer",
    "poetry.lock": "pypi",
    "pyproject.toml": "pypi",
    "requirements.txt": "pypi",
    "requirements-dev.txt": "pypi",
    "go.mod": "go",
}
# Fixed value: report order of the ecosystems.
ECOSYSTEMS = ("cargo", "npm", "pypi", "go", "composer", "rubygems")
# Licence knowledge from weakest to strongest.
AVAILABILITY = ("notinformat", "absent", "declared")
# Platform suffixes of gem versions.
GEM_PLATFORMS = (
    "x86_64-linux", "x86_64-linux-musl", "x86_64-darwin", "aarch64-linux",
    "aarch64-darwin", "arm64-darwin", "arm-linux", "x64-mingw-ucrt",
    "x64-mingw32", "x86-mingw32", "java", "universal-darwin", "sparc",
)
DEPENDENCY_COLUMNS = (
    "name", "version", "ecosystem", "license", "licence_availability",
    "manifest", "direct", "resolved",
)
_DEP = (
    "struct<name:string,version:string,license:string,availability:string,"
    "direct:boolean,resolved:boolean>"
)
_NO_DEPS = f"array<{_DEP}>"


def eco_ord(ecosystem: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in ECOSYSTEMS]), ecosystem).cast("int")


def availability_rank(availability: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in AVAILABILITY]), availability).cast("int")


def manifest_order(path: Column) -> Column:
    """Place of the file name in the look-up order; null for other files."""
    places = F.create_map(*[F.lit(x) for i, name in enumerate(MANIFESTS) for x in (name, i)])
    return F.try_element_at(places, basename(path))


def _dep(name, version, direct, resolved, license=None, can_declare=False) -> Column:
    license = F.lit(None).cast("string") if license is None else license
    known = (
        F.when(license.isNotNull(), "declared").otherwise("absent")
        if can_declare
        else F.lit("notinformat")
    )
    return F.struct(
        name.alias("name"),
        F.coalesce(version, F.lit("")).alias("version"),
        license.alias("license"),
        known.alias("availability"),
        direct.alias("direct"),
        resolved.alias("resolved"),
    ).cast(_DEP)


# -- VARIANT helpers ---------------------------------------------------------


def _json_of_any_depth():
    """(loads, walk) without recursion. They are made here so that they travel
    with the plan."""
    import json
    import re

    token = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s{}\[\],:"]+))')

    def by_tokens(text):
        """Containers on a stack of our own: (value, key waited for, what may come)."""
        stack, result, at, end = [], None, 0, len(text.rstrip(" \t\r\n"))
        may, key = {"value"}, None

        def put(value):
            nonlocal result, may
            if not stack:
                result, may = value, set()
            elif isinstance(stack[-1][0], list):
                stack[-1][0].append(value)
                may = {",", "]"}
            else:
                stack[-1][0][stack[-1][1]] = value
                may = {",", "}"}

        while at < end:
            m = token.match(text, at)
            if not m:
                raise ValueError("no JSON")
            at, (mark, string, other) = m.end(), m.groups()
            if mark and mark in "{[":
                if "value" not in may:
                    raise ValueError("no JSON")
                inner = {} if mark == "{" else []
                put(inner)
                stack.append((inner, key))
                may = {"key", "}"} if mark == "{" else {"value", "]"}
            elif mark:
                if mark not in may:
                    raise ValueError("no JSON")
                if mark == ",":
                    may = {"key"} if isinstance(stack[-1][0], dict) else {"value"}
                elif mark == ":":
                    may = {"value"}
                else:
                    stack.pop()
                    may = {",", "}" if isinstance(stack[-1][0], dict) else "]"} if stack else set()
            elif "key" in may and string:
                stack[-1] = (stack[-1][0], json.loads(string))
                may = {":"}
            elif "value" in may:
                put(json.loads(string or other))
            else:
                raise ValueError("no JSON")
        if stack or may:
            raise ValueError("no JSON")
        return result

    def loads(text):
        try:
            return json.loads(text)
        except RecursionError:
            return by_tokens(text)

    def walk(tree):
        """(name, version, license, top): parents first, keys in order."""
        out, todo = [], [(tree, name, True) for name in sorted(tree, reverse=True)]
        while todo:
            within, name, top = todo.pop()
            meta = within[name] if isinstance(within[name], dict) else {}
            text = {k: v for k, v in meta.items() if isinstance(v, str)}
            out.append((name, text.get("version", ""), text.get("license"), top))
            inner = meta.get("dependencies")
            if isinstance(inner, dict):
                todo += [(inner, x, False) for x in sorted(inner, reverse=True)]
        return out

    return loads, walk


def _toml_of_plain_lines():
    """A reader of TOML in which each statement is a header of bare names or
    ``name = value`` with a plain string, a list or an inline table of such, a
    whole number or a truth value, as lock files are made. It gives up, which
    is None, on anything else, whatever is no TOML among it: the library's
    reader, which takes several times longer, has to read that."""
    import re

    blank, string = r"[ \t]*+", r'"[^"\\\x00-\x1f\x7f]*+"'
    name, any_blank = rf"(?:[A-Za-z0-9_-]++|{string})", r"[ \t\n]*+"
    pair = rf"{name}{blank}={blank}{string}{blank}"
    listed = rf"\[{any_blank}(?:{string}{any_blank}(?:,{any_blank}{string}{any_blank})*+(?:,{any_blank})?)?\]"
    inline = rf"\{{{blank}(?:{pair}(?:,{blank}{pair})*+)?\}}"
    number = r"0|[1-9][0-9]{0,14}+|true|false"
    statement = re.compile(
        rf"{blank}(?:\[\[([A-Za-z0-9_-]++)\]\]|\[([A-Za-z0-9_.-]++)\]|({name}){blank}={blank}"
        rf"(?:({string})|({listed})|({inline})|({number})))?{blank}(?:#[^\x00-\x08\n-\x1f\x7f]*+)?(?:\n|\Z)"
    )
    strings, pairs = re.compile(string), re.compile(rf"({name}){blank}={blank}({string})")
    plain = {"true": True, "false": False}

    def bare(key):
        return key.strip('"')

    def read(text):
        root, at, end = {}, 0, len(text)
        table, lists, made = root, set(), {}
        while at < end:
            m = statement.match(text, at)
            if not m:
                return None
            at = m.end()
            many, header, key, one, array, braces, scalar = m.groups()
            if key is not None:
                key = bare(key)
                if key in table:
                    return None
                if one is not None:
                    table[key] = one[1:-1]
                elif array is not None:
                    table[key] = [x[1:-1] for x in strings.findall(array)]
                elif braces is not None:
                    inner = pairs.findall(braces)
                    table[key] = {bare(k): v[1:-1] for k, v in inner}
                    if len(table[key]) < len(inner):
                        return None
                else:
                    table[key] = plain[scalar] if scalar in plain else int(scalar)
            elif many is not None:
                if many in root and many not in lists:
                    return None
                lists.add(many)
                table = {}
                root.setdefault(many, []).append(table)
            elif header is not None:
                if header in made:
                    return None
                table, parts = root, header.split(".")
                if len(parts) > 16:
                    return None
                for i, part in enumerate(parts):
                    path = ".".join(parts[: i + 1])
                    if path not in made:
                        if part in table or not part:
                            return None
                        made[path] = table[part] = {}
                    table = made[path]
        return root

    return read


_NESTED = T.ArrayType(
    T.StructType()
    .add("name", T.StringType())
    .add("version", T.StringType())
    .add("license", T.StringType())
    .add("top", T.BooleanType())
)
_READ = T.StructType().add("json", T.StringType()).add("flat", _NESTED)


def _read_otherwise(how: Column, text: Column) -> Column:
    """(json, flat) of the texts that Spark does not read as they are; both null
    for all others, so that one Arrow pass does for every format.

    toml: the same as JSON. Dates become objects so that they are not taken for
    strings. odd: a lock file that is no VARIANT as it is, for it repeats keys,
    is too large or nested too deep, with only what is read from it, the last of
    repeated keys. Of odd ones and of the old layout ``flat`` lists the nested
    dependencies, parents first, keys in order. Null when malformed. (UDF bodies
    are local functions: they travel with the plan, and executors need not have
    this package.)"""
    loads, walk = _json_of_any_depth()
    plain_toml = _toml_of_plain_lines()

    def convert(hows, texts):
        import json
        import tomllib

        import pyarrow as pa

        read = ("name", "version", "license")

        def toml(text):
            doc = plain_toml(text)
            if doc is not None:
                return json.dumps(doc), None
            try:
                return json.dumps(tomllib.loads(text), default=lambda d: {"toml": str(d)}), None
            except (tomllib.TOMLDecodeError, TypeError):
                return None, None

        def scalar(v):
            return None if isinstance(v, (dict, list)) else v

        def shallow(v):
            if isinstance(v, dict):
                return {k: scalar(x) for k, x in v.items()}
            return [scalar(x) for x in v] if isinstance(v, list) else v

        def cut(entry):
            return {k: shallow(entry[k]) for k in read if k in entry} if isinstance(entry, dict) else scalar(entry)

        def lock(text):
            try:
                doc = loads(text)
            except ValueError:
                return None, None
            return (doc, walk(doc["dependencies"]) if isinstance(doc.get("dependencies"), dict) else []) if isinstance(doc, dict) else (None, None)

        def odd(text):
            doc, flat = lock(text)
            if doc is None:
                return None, None
            out = {}
            for key in ("packages", "packages-dev"):
                entries = doc.get(key)
                if isinstance(entries, list):
                    out[key] = [cut(e) for e in entries]
                elif isinstance(entries, dict):
                    out[key] = {k: cut(e) for k, e in entries.items()}
                    root = entries.get("")
                    if isinstance(root, dict) and "dependencies" in root:
                        out[key][""]["dependencies"] = shallow(root["dependencies"])
            return json.dumps(out), flat

        by = {"toml": toml, "odd": odd, "old": lambda text: (None, lock(text)[1])}
        none = (None, None)
        hows, texts = hows.to_pylist(), texts.to_pylist()
        found = [by[how](text) if how else none for how, text in zip(hows, texts)]
        flat = [f[1] and [dict(zip(("name", "version", "license", "top"), d)) for d in f[1]] for f in found]
        dep = pa.struct([("name", pa.string()), ("version", pa.string()), ("license", pa.string()), ("top", pa.bool_())])
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array(flat, pa.list_(dep))], ["json", "flat"]
        )

    return F.arrow_udf(convert, _READ)(how, F.when(how.isNotNull(), text))


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text_at(v: Column, path: str) -> Column:
    """The value only if it is a JSON string."""
    return F.when(_kind(_at(v, path, "variant")) == "STRING", _at(v, path, "string"))


def _object_at(v: Column, path: str) -> Column:
    """Entries of an object in key order, empty when it is none."""
    return F.coalesce(
        F.map_entries(_at(v, path, "map<string,variant>")),
        F.array().cast("array<struct<key:string,value:variant>>"),
    )


def _list_at(v: Column, path: str) -> Column:
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


# -- formats -----------------------------------------------------------------


def _npm_packages(doc: Column) -> Column:
    root_names = F.transform(
        _object_at(doc, '$.packages[""].dependencies'), lambda e: e["key"]
    )

    def package(e: Column, root_names: Column) -> Column:
        name = F.substring_index(e["key"], "node_modules/", -1)
        folder = "node_modules/"
        depth = (F.length(e["key"]) - F.length(F.replace(e["key"], F.lit(folder), F.lit("")))) / len(folder)
        return _dep(
            name,
            _text_at(e["value"], "$.version"),
            (depth == 1) & F.array_contains(root_names, name),
            F.lit(True),
            _text_at(e["value"], "$.license"),
            can_declare=True,
        )

    found = let(
        root_names, lambda names: F.transform(_object_at(doc, "$.packages"), lambda e: package(e, names))
    )
    return F.filter(found, lambda d: d["name"] != "")


def _npm_nested(nested: Column) -> Column:
    return F.transform(
        nested,
        lambda d: _dep(
            d["name"], d["version"], d["top"], F.lit(True), d["license"], can_declare=True
        ),
    )


def _cargo_lock(doc: Column) -> Column:
    is_member = lambda p: _at(p, "$.source", "variant").isNull()

    def direct(packages: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(packages, is_member),
                lambda p: F.transform(
                    _list_at(p, "$.dependencies"),
                    lambda d: F.element_at(split_on(trim_ws(d.cast("string")), f"{UNICODE}{WS}+"), 1),
                ),
            )
        )

    def used(packages: Column, direct: Column) -> Column:
        named = F.filter(
            packages, lambda p: ~is_member(p) & _text_at(p, "$.name").isNotNull()
        )
        return F.transform(
            named,
            lambda p: _dep(
                _text_at(p, "$.name"),
                _text_at(p, "$.version"),
                F.array_contains(direct, _text_at(p, "$.name")),
                F.lit(True),
            ),
        )

    return let(
        _list_at(doc, "$.package"), lambda ps: let(direct(ps), lambda names: used(ps, names))
    )


def _spec_table(entries: Column) -> Column:
    """name = "version" or name = { version, license, .. }"""

    def spec(e: Column) -> Column:
        is_text = _kind(e["value"]) == "STRING"
        return _dep(
            e["key"],
            F.when(is_text, e["value"].cast("string")).otherwise(_text_at(e["value"], "$.version")),
            F.lit(True),
            F.lit(False),
            _text_at(e["value"], "$.license"),
            can_declare=True,
        )

    return F.transform(entries, spec)


def _cargo_toml(doc: Column) -> Column:
    def tables(v: Column) -> Column:
        return F.concat(
            *[
                _spec_table(
                    F.filter(_object_at(v, f'$["{k}"]'), lambda e: ~F.startswith(e["key"], F.lit(".")))
                )
                for k in ("dependencies", "dev-dependencies", "build-dependencies")
            ]
        )

    targets = F.transform(_object_at(doc, "$.target"), lambda e: tables(e["value"]))
    return F.concat(tables(doc), F.flatten(targets))


def _requirement(raw: Column) -> Column:
    """``name[extra] == version ; marker`` as a dependency; null for options,
    URLs and blanks."""
    spec = trim_ws(F.substring_index(trim_ws(raw), ";", 1))
    spec = trim_ws(F.substring_index(spec, " --hash", 1))

    def parts(s: Column) -> Column:
        name = trim_ws(F.substring_index(F.regexp_extract(s, r"(?s)^([^=<>!~]*)", 1), "[", 1))
        version = trim_ws(
            F.regexp_replace(trim_ws(F.regexp_extract(s, r"(?s)^[^=<>!~]*(.*)$", 1)), "^==", "")
        )
        usable = (name != "") & ~F.startswith(s, F.lit("-")) & ~F.contains(s, F.lit("://"))
        return F.when(usable, _dep(name, version, F.lit(True), F.lit(False)))

    return let(spec, parts)


def _requirements(text: Column) -> Column:
    found = F.transform(lines(text), lambda l: _requirement(F.substring_index(l, "#", 1)))
    return F.filter(found, lambda d: d.isNotNull())


def _pyproject(doc: Column) -> Column:
    listed = F.transform(
        F.filter(_list_at(doc, "$.project.dependencies"), lambda v: _kind(v) == "STRING"),
        lambda v: _requirement(v.cast("string")),
    )
    table = F.filter(
        _object_at(doc, "$.tool.poetry.dependencies"), lambda e: F.lower(e["key"]) != "python"
    )
    return F.concat(F.filter(listed, lambda d: d.isNotNull()), _spec_table(table))


def _poetry_lock(doc: Column) -> Column:
    named = F.filter(_list_at(doc, "$.package"), lambda p: _text_at(p, "$.name").isNotNull())
    return F.transform(
        named,
        lambda p: _dep(
            _text_at(p, "$.name"),
            _text_at(p, "$.version"),
            F.lower(F.coalesce(_text_at(p, "$.category"), F.lit(""))) != "dev",
            F.lit(True),
            _text_at(p, "$.license"),
            can_declare=True,
        ),
    )


def _go_mod(text: Column) -> Column:
    """A require block runs from ``require (`` to the next line that is only a
    closing parenthesis."""
    rows = F.transform(
        lines(text),
        lambda raw: F.struct(
            trim_ws(F.substring_index(raw, "//", 1)).alias("t"),
            F.contains(raw, F.lit("// indirect")).alias("indirect"),
        ),
    )
    state = f"struct<open:boolean,deps:{_NO_DEPS}>"

    def module(words: Column, indirect: Column) -> Column:
        return _dep(
            F.element_at(words, 1), F.element_at(words, 2), ~indirect, F.lit(False)
        )

    def step(s: Column, l: Column) -> Column:
        is_require = F.startswith(l["t"], F.lit("require"))
        rest = trim_ws(F.regexp_replace(l["t"], "^(require)+", ""))
        opens = is_require & rest.isin("", "(")
        closes = l["t"] == ")"
        may = ~opens & ~closes & (is_require | s["open"])
        words = split_on(F.when(is_require, rest).otherwise(l["t"]), f"{UNICODE}{WS}+")
        added = let(
            words,
            lambda ws: F.when(F.size(ws) >= 2, F.array_append(s["deps"], module(ws, l["indirect"]))).otherwise(s["deps"]),
        )
        return F.struct(
            F.when(opens, True).when(closes, False).otherwise(s["open"]).alias("open"),
            F.when(may, added).otherwise(s["deps"]).alias("deps"),
        ).cast(state)

    start = F.struct(F.lit(False).alias("open"), F.array().cast(_NO_DEPS).alias("deps")).cast(state)
    return F.aggregate(rows, start, step, lambda s: s["deps"])


def _composer_lock(doc: Column) -> Column:
    def packages(key: str, direct: bool) -> Column:
        named = F.filter(_list_at(doc, f'$["{key}"]'), lambda p: _text_at(p, "$.name").isNotNull())
        return F.transform(
            named,
            lambda p: _dep(
                _text_at(p, "$.name"),
                _text_at(p, "$.version"),
                F.lit(direct),
                F.lit(True),
                F.coalesce(_text_at(p, "$.license"), _text_at(p, "$.license[0]")),
                can_declare=True,
            ),
        )

    return F.concat(packages("packages", True), packages("packages-dev", False))


def _gem(line: Column) -> Column:
    """``name (version)`` with an optional trailing mark; null if no name."""
    platforms = "|".join(p.replace("-", "\\-") for p in sorted(GEM_PLATFORMS, key=len, reverse=True))

    def parts(s: Column) -> Column:
        has_version = F.rlike(s, F.lit(r"(?s)\(.*\)$"))
        name = trim_ws(F.when(has_version, F.regexp_extract(s, r"(?s)^(.*)\(", 1)).otherwise(s))
        version = trim_ws(F.regexp_extract(s, r"(?s)^.*\((.*)\)$", 1))
        return F.when(
            (name != "") & ~F.endswith(name, F.lit(":")),
            F.struct(
                name.alias("name"),
                F.regexp_replace(version, f"-(?:{platforms})$", "").alias("version"),
            ),
        )

    return let(trim_ws(F.regexp_replace(trim_ws(line), "!+$", "")), parts)


def _gemfile_lock(text: Column) -> Column:
    """Sections start at lines without indent, sub-sections at lines with an
    indent of one or two that end in a colon; both are cut out by splitting."""
    content = F.filter(
        lines(text), lambda l: (trim_ws(l) != "") & ~F.startswith(trim_ws(l), F.lit("#"))
    )
    sections = split_on(F.array_join(content, "\n"), rf"{UNICODE}\n(?!{WS})")
    title = lambda s: trim_ws(F.substring_index(s, "\n", 1))

    def gems(block: Column) -> Column:
        rows = F.split(block, "\n", -1)
        return F.filter(
            F.transform(F.slice(rows, 2, F.size(rows) - 1), _gem), lambda g: g.isNotNull()
        )

    def blocks(sections: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(sections, lambda s: title(s) == "GEM"),
                lambda s: F.filter(
                    split_on(s, rf"{UNICODE}\n(?={WS}{{1,2}}[^\s][^\n]*:\s*(?:\n|$))"),
                    lambda b: title(b) == "specs:",
                ),
            )
        )

    def direct(sections: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(sections, lambda s: title(s) == "DEPENDENCIES"),
                lambda s: gems(F.regexp_replace(s, rf"{UNICODE}\n{WS}+![^\n]*", "")),
            )
        )

    return let(
        sections,
        lambda ss: let(
            F.transform(direct(ss), lambda g: g["name"]),
            lambda names: F.transform(
                F.flatten(F.transform(blocks(ss), gems)),
                lambda g: _dep(
                    g["name"], g["version"], F.array_contains(names, g["name"]), F.lit(True)
                ),
            ),
        ),
    )


def _in_order(deps: Column, repeats: Column) -> Column:
    """Dependencies with their place in the manifest. Unless the format may
    repeat names, only the first of each name stays: neighbours after a sort."""
    rows = F.transform(
        deps, lambda d, i: F.struct(d["name"].alias("name"), i.alias("seq"), d.alias("d"))
    )
    return let(
        F.sort_array(rows),
        lambda rs: F.filter(
            rs,
            lambda r, i: repeats
            | (i == 0)
            | (F.get(rs, i - 1)["name"] != r["name"]),
        ),
    )


# -- operators ---------------------------------------------------------------


@lru_cache(maxsize=4)
def _manifest_columns(application: str) -> tuple[Column, Column, Column, Column]:
    """(text as VARIANT, what is read otherwise, dependencies in order, ecosystem)
    of rows with the columns base, text, plain, read and doc. Kept per
    application, to which UDFs belong."""
    base, text, plain, doc = F.col("base"), F.col("text"), F.col("plain"), F.col("doc")
    is_toml = F.endswith(base, F.lit(".toml")) | base.isin("Cargo.lock", "poetry.lock")
    is_json = F.endswith(base, F.lit(".json")) | (base == "composer.lock")
    is_npm = base.isin("package-lock.json", "npm-shrinkwrap.json")
    packages = lambda v: _at(v, "$.packages", "struct<>").isNotNull()
    how = (
        F.when(is_toml, "toml")
        .when(is_json & plain.isNull(), "odd")
        .when(is_npm & ~packages(plain), "old")
    )
    deps = (
        F.when(is_npm, F.when(packages(doc), _npm_packages(doc)).otherwise(_npm_nested(F.col("read.flat"))))
        .when(base == "Cargo.lock", _cargo_lock(doc))
        .when(base == "Cargo.toml", _cargo_toml(doc))
        .when(base == "Gemfile.lock", _gemfile_lock(text))
        .when(base == "composer.lock", _composer_lock(doc))
        .when(base == "poetry.lock", _poetry_lock(doc))
        .when(base == "pyproject.toml", _pyproject(doc))
        .when(base == "go.mod", _go_mod(text))
        .otherwise(_requirements(text))
    )
    repeats = base.isin("Cargo.lock", "poetry.lock", "Gemfile.lock")
    ecosystem = F.element_at(
        F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), base
    )
    parsed = F.when(is_json, F.try_parse_json(text))
    return parsed, _read_otherwise(how, text), _in_order(deps, repeats), ecosystem


def _manifest_rows(files: DataFrame) -> DataFrame:
    plain, read, _, _ = _manifest_columns(files.sparkSession.sparkContext.applicationId)
    return (
        files.withColumn("cand", manifest_order(F.col("path")))
        .filter("cand is not null and text is not null")
        .select("path", "text", "cand", basename(F.col("path")).alias("base"))
        .withColumn("plain", plain)
        .withColumn("read", read)
        .withColumn("doc", F.coalesce("plain", F.try_parse_json("read.json")))
    )


def unreadable_manifests(files: DataFrame) -> DataFrame:
    """(path) of the manifests that are no valid TOML or JSON."""
    by_tree = F.col("base").rlike(r"\.(toml|json)$") | F.col("base").isin("Cargo.lock", "poetry.lock", "composer.lock")
    return _manifest_rows(files).filter(by_tree & F.col("doc").isNull()).select("path")


def parse_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of every manifest among (path, text) rows, one row each.

    Malformed manifests give no rows. ``seq`` is the order of a row within its
    manifest and ``cand`` that of the manifest name."""
    _, _, deps, ecosystem = _manifest_columns(files.sparkSession.sparkContext.applicationId)
    rows = _manifest_rows(files)
    return rows.select("path", "cand", ecosystem.alias("ecosystem"), F.explode(deps).alias("row")).select(
        "row.d.name",
        "row.d.version",
        "ecosystem",
        "row.d.license",
        F.col("row.d.availability").alias("licence_availability"),
        F.col("path").alias("manifest"),
        "row.d.direct",
        "row.d.resolved",
        "cand",
        "row.seq",
    )


def merge_inventory(deps: DataFrame) -> DataFrame:
    """One row per (ecosystem, name) over all manifests.

    The first row is the base. A version comes from the first resolved row,
    else from the first that has one; a licence from the first that declares
    one; availability is the best, directness is any. All of it is one hash
    aggregate with map-side combining."""
    order = F.struct("cand", "manifest", "seq")
    first_of = lambda value, cond: F.min_by(
        value, F.when(cond, order)
    )
    resolved = F.col("resolved")
    # a hash in front: the sort below the aggregate compares one number per pair of rows
    out = deps.groupBy(F.xxhash64("ecosystem", "name").alias("_hash"), "ecosystem", "name").agg(
        first_of("version", resolved).alias("_resolved_version"),
        F.coalesce(first_of("version", F.col("version") != ""), F.lit("")).alias("_any_version"),
        first_of("license", F.col("license").isNotNull()).alias("license"),
        F.max(availability_rank(F.col("licence_availability"))).alias("_rank"),
        F.min_by("manifest", order).alias("manifest"),
        F.bool_or("direct").alias("direct"),
        F.bool_or("resolved").alias("resolved"),
    )
    return out.select(
        "name",
        F.coalesce("_resolved_version", "_any_version").alias("version"),
        "ecosystem",
        "license",
        F.element_at(F.array(*[F.lit(a) for a in AVAILABILITY]), F.col("_rank")).alias(
            "licence_availability"
        ),
        "manifest",
        "direct",
        "resolved",
    )


def inventory_order(deps: DataFrame) -> DataFrame:
    """By ecosystem, in its fixed order, then by name."""
    return deps.orderBy(eco_ord(F.col("ecosystem")), "name")


def inventory(files: DataFrame) -> DataFrame:
    return merge_inventory(parse_manifests(files))
