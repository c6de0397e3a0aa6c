"""SQL counterparts of the queries, for DuckDB."""

from __future__ import annotations

from tamis.llm import secrets, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_verdicts() -> str:
    fits, verdicts = "NULL", "NULL"
    for r in sorted(url_filter.RULES, key=lambda r: len(r.name)):
        when = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        fits = f"CASE WHEN {when} THEN '{r.name}' ELSE {fits} END"
        verdicts = f"CASE WHEN {when} THEN '{r.verdict}' ELSE {verdicts} END"
    long = ", ".join(f"'{x}'" for x in url_filter.LONG_SUFFIXES)
    last = "array_to_string(string_split(host, '.')[-{}:], '.')".format

    def shrunk(name: str, children: str, parents: str, key: str, parent: str) -> str:
        return f"""
{name}_j AS (SELECT c.*, p.mean AS prior FROM {children} c JOIN {parents} p USING ({parent})),
{name}_s AS (SELECT sum(n * pow(bad / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS noise,
             sum(n * prior * (1 - prior)) AS size FROM {name}_j),
{name}_w AS (SELECT CASE WHEN spread > noise
             THEN least(greatest((size - noise) / (spread - noise) - 1, {url_filter.MIN_WEIGHT}), {url_filter.MAX_WEIGHT})
             ELSE {url_filter.MAX_WEIGHT} END AS w FROM {name}_s),
{name} AS (SELECT *, a / (a + b) AS mean FROM (
             SELECT {name}_j.* EXCLUDE (n, bad, prior), bad + w * prior AS a, n - bad + w * (1 - prior) AS b
             FROM {name}_j, {name}_w))"""

    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT page_id, host, path, {fits} AS rule, {verdicts} AS listed FROM parsed),
hosts AS (SELECT host, CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain,
             CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END AS suffix,
             CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE listed = 'block') AS DOUBLE) AS bad
             FROM ruled WHERE listed IS NOT NULL GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS every, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
everything AS (SELECT every, (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM suffixes GROUP BY every),
{shrunk("s", "suffixes", "everything", "suffix", "every")},
{shrunk("d", "domains", "s", "domain", "suffix")},
{shrunk("h", "(SELECT * EXCLUDE (suffix) FROM hosts)", "d", "host", "domain")},
blocked AS (SELECT host FROM h WHERE mean - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5)
SELECT page_id, host, path, rule,
       coalesce(listed, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum(list_transform(range(1, len(v.a) + 1), lambda i: q.a[i] * v.a[i])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.a) = len(v.a)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def secret_spans() -> str:
    # A least length of the whole match may stand in the expression itself.
    found = []
    for n, r in enumerate(secrets.RULES):
        regex = r.regex.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join(
            "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
            for w in ("password", "passwd", "secret", "token", "api_?key")
        ) + ")").replace("*+", "*").replace("'", "''")
        if not r.group and regex.endswith("+"):
            head = {"AKIA[A-Z0-9]+": 4, "gh[pousr]_[A-Za-z0-9]+": 4, "xox[abprs]-[A-Za-z0-9-]+": 5}.get(r.regex, 0)
            regex = f"{regex[:-1]}{{{r.least - head},}}"
        found.append(f"""
SELECT doc_id, '{r.kind}' AS kind, {n} AS place, s AS start, s + length(m) AS "end" FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i:
           list_sum(list_transform(pieces[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s,
         unnest(ms) AS m, unnest(gs) AS g
  FROM (SELECT doc_id, string_split_regex(text, '{regex}') AS pieces, regexp_extract_all(text, '{regex}', 0) AS ms,
               regexp_extract_all(text, '{regex}', {r.group}) AS gs FROM documents WHERE text IS NOT NULL))
WHERE length(g) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    listed = """string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, place)"""
    return f"""
WITH spans AS ({" UNION ALL ".join(found)})
SELECT d.doc_id, {counts},
       sha256(coalesce({listed} FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
       coalesce({listed} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM (SELECT doc_id FROM documents) d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


_WORDS = f"""regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS pattern
          FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, n, i, w[i:i + n - 1] AS pattern
           FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, n, i, item_id FROM places JOIN items USING (n, pattern)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _crc32(text: str) -> str:
    """Of the UTF-8 bytes, a bit after the other."""
    return f"""xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode({text})) + 1),
        lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i - 1, 2)) AS BIGINT)),
        lambda r, b: list_reduce(range(8), lambda q, i: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END, xor(r, b)),
        4294967295))"""


def merkle_manifest(levels: int = 5) -> str:
    """``levels`` levels in each tree suffice for 8 ** levels leaves and as many languages."""

    def part(value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(*values: str) -> str:
        return f"sha256({' || '.join(map(part, values))})"

    fields = ("doc_id", "source", "lang", "n_chars")
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    steps, last = [], "leaves"
    for i in range(2 * levels):
        if i == levels:  # the subroots are the leaves of one more tree
            steps.append(f"""
subroots AS MATERIALIZED (SELECT tree AS lang, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM {last}),
below AS MATERIALIZED (SELECT f.id, f.doc_id, f.leaf, f.siblings, f.folded, s.digest AS subroot, s.tree, s.place
    FROM {last}_f f JOIN subroots s ON s.lang = f.tree)""")
            last = "subroots"
        here, rows = f"l{i}", "below" if i == levels else f"{last}_f" if i else "leaves_f"
        keep = ", subroot" if i >= levels else ""
        steps.append(f"""
{last}_n AS (SELECT tree, count(*) AS n FROM {last} GROUP BY tree),
{here} AS MATERIALIZED (SELECT tree, CASE WHEN n > 1 THEN place // 8 ELSE place END AS place,
    CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE min(digest) END AS digest
    FROM {last} JOIN {last}_n USING (tree) GROUP BY tree, n, CASE WHEN n > 1 THEN place // 8 ELSE place END),
{here}_f AS MATERIALIZED (SELECT f.id, f.doc_id, f.leaf{keep}, f.tree, CASE WHEN n > 1 THEN f.place // 8 ELSE f.place END AS place,
    f.siblings || CASE WHEN n > 1 THEN coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place <> f.place), '') ELSE '' END AS siblings,
    CASE WHEN n > 1 THEN sha256(string_agg(CASE WHEN s.place = f.place THEN f.folded ELSE s.digest END, '' ORDER BY s.place)) ELSE f.folded END AS folded
    FROM {rows} f JOIN {last}_n USING (tree) JOIN {last} s ON s.tree = f.tree AND s.place // 8 = f.place // 8
    GROUP BY f.id, f.doc_id, f.leaf{keep}, f.tree, f.place, f.siblings, f.folded, n)""")
        last = here
    return f"""
WITH hashed AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf(*fields, "text")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(*fields, low)} ELSE {leaf(*fields, "text")} END AS folded FROM documents),
placed AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
leaves AS MATERIALIZED (SELECT tree, place, leaf AS digest FROM placed),
leaves_f AS MATERIALIZED (SELECT id, doc_id, leaf, tree, place, '' AS siblings, folded FROM placed),{",".join(steps)}
SELECT f.doc_id, f.leaf, f.subroot, r.digest AS root, sha256(f.siblings) AS proof_sha256, f.folded AS folded_root,
       f.folded = r.digest AS verified
FROM {last}_f f, {last} r"""


# Words that are one letter apart: one is the other without a letter, or both are the same without the letter at one place.
SPELLING = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(id || ':' || run)")} AS h FROM runs),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
without AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
shorter AS (SELECT DISTINCT v.word AS a, w.word AS b FROM without v JOIN words w ON v.rest = w.word),
pairs AS (SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter UNION ALL
    SELECT DISTINCT v.word, w.word FROM without v JOIN without w ON v.rest = w.rest AND v.i = w.i AND v.word <> w.word),
near AS (SELECT a AS word, count(*) AS n_near, min({{'minus': -n, 'near': b}}) AS best FROM pairs JOIN words ON b = word GROUP BY a),
forms AS MATERIALIZED (SELECT word, CASE WHEN -best.minus >= 5 * n THEN best.near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.minus >= 5 * n THEN -best.minus END AS form_n FROM words LEFT JOIN near USING (word)),
way AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL
    SELECT way.word, form, step + 1 FROM way JOIN forms f ON f.word = last WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN (SELECT word, max_by(last, step) AS root FROM way GROUP BY word) USING (word)"""
