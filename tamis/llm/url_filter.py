"""URL verdicts: listed rules, and an empirical-Bayes reputation of hosts.

A page's outcome is bad or not. The bad share of a host is shrunk towards that
of its registered domain, the domain's towards its suffix, the suffix's towards
all pages. At each level a beta-binomial prior has the parent's posterior mean
and a weight found by moments from how far siblings differ. A host is blocked if
its share is surely above the limit: if the lower bound of its posterior is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import written


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
# Suffixes of two labels under which names are registered (fixed values).
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
MIN_WEIGHT, MAX_WEIGHT = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_column(host: Column, path: Column, rules: Sequence[UrlRule], value: str) -> Column:
    """``value`` (name or verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(LONG_SUFFIXES)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    three = F.substring_index(host, ".", -3)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(LONG_SUFFIXES)), three).otherwise(two)


def _shrunk(siblings: DataFrame, *keys: str) -> DataFrame:
    """``siblings`` (keys, n, bad and the mean to shrink to, ``prior``) with the
    posterior's a and b and its mean. The weight of the prior is that of a
    beta-binomial whose variance between siblings is the one found."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2))
    noise = F.sum(F.col("prior") * (1 - F.col("prior")))
    size = F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior")))
    # E[spread] = noise + (size - noise) / (weight + 1), siblings of all parents together
    found, noise_of, size_of = siblings.agg(spread, noise, size).first()
    weight = MAX_WEIGHT
    if found is not None and found > noise_of:
        weight = min(max((size_of - noise_of) / (found - noise_of) - 1, MIN_WEIGHT), MAX_WEIGHT)
    a, b = F.col("bad") + weight * F.col("prior"), F.col("n") - F.col("bad") + weight * (1 - F.col("prior"))
    return siblings.select(*keys, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputations(pages: DataFrame, z: float = 1.645) -> DataFrame:
    """``pages`` (host, bad) to host, mean and lower and upper posterior bounds
    (normal approximation at ``z``). Pages without an outcome (bad is null) do
    not count. Counts are combined before the shuffle and roll up from hosts."""
    hosts = (
        pages.where("bad is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    )
    hosts = written(hosts, "hosts").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffix = _shrunk(total(hosts, "suffix").withColumn("prior", F.lit((bad + 0.5) / (n + 1))), "suffix")
    prior = lambda parents, key: parents.select(key, F.col("mean").alias("prior"))
    domain = _shrunk(domains.join(prior(suffix, "suffix"), "suffix"), "domain")
    host = _shrunk(hosts.join(prior(domain, "domain"), "domain"), "host")
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return host.select("host", "mean", (F.col("mean") - z * sd).alias("low"), (F.col("mean") + z * sd).alias("high"))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest fitting rule decides. A page that no rule fits is blocked if the
    lower bound of its host's bad share is above ``limit``. The labelled outcome
    of a page is what the list says of it: bad if a rule blocks it, not bad if a
    rule allows it. A page that no rule lists has no outcome and does not count,
    and a host without any outcome is allowed. Null urls and urls without ://
    have the empty host, which is judged like any other; repeated rows count each."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = parsed.withColumns(
        {"rule": rule_column(host, path, rules, "name"), "listed": rule_column(host, path, rules, "verdict")}
    )
    outcomes = ruled.select("host", (F.col("listed") == "block").alias("bad"))
    blocked = reputations(outcomes, z).where(F.col("low") > limit).select(F.col("host").alias("bad_host"))
    # pages with a rule need no reputation: they meet no host
    key = F.when(F.col("rule").isNull(), host)
    return ruled.join(blocked, key == F.col("bad_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
