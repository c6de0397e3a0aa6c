"""Package names that look like well-known ones.

Every way to resemble a name is turned into an equality: both sides list the
keys under which they could meet, and one equi-join finds the pairs. For edit
distance the keys are the names with up to two characters left out, which two
names within that distance always share. So no name is compared with a whole
list, however long the inventory or the list is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import let
from tamis.operators.inventory import eco_ord
from tamis.sources.known_names import KNOWN_NAMES
from tamis.sources.small import small_table

# Look-alike characters and what they are read as. Pairs first:
# no single replacement creates one of them, but the other way round "1" would.
_PAIRS = (("rn", "m"), ("cl", "d"))
_SINGLES = ("0134578", "oleastb")
# Words that impostors append.
AFFIXES = ("copy", "fork", "fake", "malware", "backdoor", "secure", "patched", "pro")
# Lower is more suspicious.
AFFIX_SCORE, SUBSTITUTION_SCORE, SEPARATOR_SCORE, EDIT_BASE_SCORE = 1, 2, 3, 4
# Names this long may differ in two places, shorter ones in one.
LONG_NAME = 8
SHORTEST_ALIKE = 4
MAX_EDITS = 2
# A list of known names is a small reference table; beyond this size the join
# is left to Spark.
BROADCAST_ROWS = 20_000


def normalise_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", ""))


def fold_lookalikes(name: Column) -> Column:
    for pair, single in _PAIRS:
        name = F.replace(name, F.lit(pair), F.lit(single))
    return F.translate(name, *_SINGLES)


def _deletions(names: Column) -> Column:
    """Every string of the array with any one character left out."""
    return F.flatten(
        F.transform(
            names,
            lambda s: F.transform(
                F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))),
                lambda i: F.concat(
                    F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))
                ),
            ),
        )
    )


def _edit_keys(name: Column, edits: Column) -> Column:
    one = F.array_distinct(_deletions(F.array(name)))
    return let(
        one,
        lambda ks: F.array_distinct(
            F.concat(
                F.array(name),
                ks,
                F.when(edits >= MAX_EDITS, _deletions(ks)).otherwise(
                    F.array().cast("array<string>")
                ),
            )
        ),
    )


def _stems(name: Column) -> Column:
    """The name without an affix, for each affix it ends with."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.endswith(name, F.lit(a)),
                    F.substring(name, F.lit(1), F.length(name) - len(a)),
                )
                for a in AFFIXES
            ]
        )
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment: insert, delete, replace, swap neighbours."""
    letters = lambda s: F.filter(F.split(s, "", -1), lambda c: c != "")
    rows = "struct<above:array<int>,last:array<int>>"

    def table(x: Column, y: Column) -> Column:
        def row(s: Column, i: Column) -> Column:
            def cell(row: Column, j: Column) -> Column:
                same = F.get(x, i - 1) == F.get(y, j - 1)
                swapped = (F.get(x, i - 2) == F.get(y, j - 1)) & (
                    F.get(x, i - 1) == F.get(y, j - 2)
                )
                return F.array_append(
                    row,
                    F.least(
                        F.get(s["last"], j - 1) + F.when(same, 0).otherwise(1),
                        F.get(s["last"], j) + 1,
                        F.get(row, j - 1) + 1,
                        F.when(swapped, F.get(s["above"], j - 2) + 1),
                    ),
                ).cast("array<int>")

            new = F.aggregate(_upto(F.size(y)), F.array(i).cast("array<int>"), cell)
            return F.struct(s["last"].alias("above"), new.alias("last")).cast(rows)

        first = F.sequence(F.lit(0), F.size(y))
        start = F.struct(first.alias("above"), first.alias("last")).cast(rows)
        return F.aggregate(_upto(F.size(x)), start, row, lambda s: F.element_at(s["last"], -1))

    return let(letters(a), lambda x: let(letters(b), lambda y: table(x, y)))


def _upto(n: Column) -> Column:
    """1..n, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def known_names(spark: SparkSession, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(ecosystem, known, rank): well-known names, most popular first."""
    rows = [
        {"ecosystem": eco, "known": name, "rank": rank}
        for eco, listed in (names or KNOWN_NAMES).items()
        for rank, name in enumerate(listed)
    ]
    return small_table(spark, rows, "ecosystem:string,known:string,rank:int")


def _keys(kind: str, keys: Column) -> Column:
    return F.transform(
        keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    )


def lookalikes(inventory: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Suspects: package, version, ecosystem, impersonates, signal, score."""
    spark = inventory.sparkSession
    listed = known_names(spark) if known is None else known
    c, n = F.col("c_norm"), F.col("n_norm")
    edits = F.when(F.length(c) >= LONG_NAME, MAX_EDITS).otherwise(1)
    alike = F.octet_length(c) >= SHORTEST_ALIKE
    none = F.array().cast("array<string>")
    known_keys = listed.withColumn("c_norm", normalise_name(F.col("known"))).select(
        "ecosystem",
        "known",
        "rank",
        "c_norm",
        F.explode(
            F.concat(
                _keys("edit", _edit_keys(c, edits)),
                _keys("fold", F.when(alike, F.array(c)).otherwise(none)),
                # the package is a known name plus an affix, or the reverse
                _keys("longer", F.when(alike, F.array(c)).otherwise(none)),
                _keys("shorter", F.when(alike, _stems(c)).otherwise(none)),
            )
        ).alias("k"),
    ).select("ecosystem", "known", "rank", "c_norm", "k.kind", "k.key")
    if known is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known_keys = F.broadcast(known_keys)
    names = inventory.groupBy("ecosystem", "name").agg(F.min("version").alias("version"))
    name_keys = (
        names.withColumn("n_norm", normalise_name(F.col("name")))
        .filter("n_norm <> ''")
        .select(
            "ecosystem",
            "name",
            "version",
            "n_norm",
            F.explode(
                F.concat(
                    # A known name of LONG_NAME characters is at most two longer.
                    _keys(
                        "edit",
                        _edit_keys(
                            n, F.when(F.length(n) >= LONG_NAME - MAX_EDITS, MAX_EDITS).otherwise(1)
                        ),
                    ),
                    _keys("fold", F.array(fold_lookalikes(n))),
                    _keys("longer", _stems(n)),
                    _keys("shorter", F.array(n)),
                )
            ).alias("k"),
        )
        .select("ecosystem", "name", "version", "n_norm", "k.kind", "k.key")
    )
    same = n == c
    d = F.col("edits")
    kind = F.col("kind")
    affix = F.when(kind == "longer", F.substring(n, F.length(c) + 1, F.length(n))).otherwise(
        F.substring(c, F.length(n) + 1, F.length(c))
    )
    scored = (
        name_keys.join(known_keys, ["ecosystem", "kind", "key"])
        .select("ecosystem", "name", "version", "known", "rank", "n_norm", "c_norm", "kind")
        .distinct()
        .withColumn("edits", F.when((kind == "edit") & ~same, edit_distance(n, c)))
        .select(
            "ecosystem",
            "name",
            "version",
            "known",
            "rank",
            (F.lower("known") == F.lower("name")).alias("itself"),
            F.when(same, SEPARATOR_SCORE)
            .when(kind == "edit", F.when(d <= edits, EDIT_BASE_SCORE + d))
            .when(kind == "fold", SUBSTITUTION_SCORE)
            .otherwise(AFFIX_SCORE)
            .alias("score"),
            F.when(same, "separator-only variant")
            .when(kind == "edit", F.concat(F.lit("edit-distance "), d.cast("string")))
            .when(kind == "fold", "character substitution")
            .when(kind == "longer", F.concat(F.lit("real name plus '"), affix, F.lit("'")))
            .otherwise(F.concat(F.lit("popular name plus '"), affix, F.lit("'")))
            .alias("signal"),
        )
        .filter("score is not null")
    )
    best = scored.groupBy("ecosystem", "name", "version").agg(
        F.min_by(F.struct("known", "signal", "score"), F.struct("score", "rank")).alias("best"),
        F.bool_or("itself").alias("itself"),
    )
    return best.filter("not itself").select(
        F.col("name").alias("package"),
        "version",
        "ecosystem",
        F.col("best.known").alias("impersonates"),
        "best.signal",
        F.col("best.score").cast("int").alias("score"),
    )


def suspect_order(suspects: DataFrame) -> DataFrame:
    return suspects.orderBy("score", eco_ord(F.col("ecosystem")), "package")


def suspects_by_ecosystem(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("ecosystem").agg(
        F.count("*").alias("suspects"), F.min("score").alias("worst_score")
    )


def suspect_line() -> Column:
    """Display form of a suspect."""
    return F.format_string(
        "%s %s [%s] resembles '%s' (%s)",
        "package",
        F.when(F.col("version") == "", "-").otherwise(F.col("version")),
        "ecosystem",
        "impersonates",
        "signal",
    )
