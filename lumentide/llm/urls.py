"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix.
Each level shrinks towards the one above it: a unit with k bad of n pages has the
beta-binomial mean (k + m p) / (n + m), where p is its parent's mean and m, the strength
of that level's prior, follows by moments from how much units differ from their parents.
A unit without outcomes has n = k = 0, so its parent's mean with the prior's strength.
A host is blocked where even the lower posterior bound of its bad share is over the
limit. Explicit rules come first; the longest that fits wins.

A suffix is a host's last label, or its last two where a country's registry registers
below a label of its own (``co.uk``); the registered domain has one label more.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged as the host ``''``. Repeated rows are judged each; ties between rules of one
length go by their text. Null outcomes are no outcomes; repeated outcomes of a page count
each; with no outcomes at all nothing is blocked by the method. A null page id has no
outcomes. Extra columns are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentide.llm.shared import Shared, with_facts

#: fixed values: labels below which country registries register names
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org")


@dataclass(frozen=True)
class Reputation:
    """``z``: posterior standard deviations below the mean; ``limit``: bad share from which a host is blocked."""

    z: float = 1.645
    limit: float = 0.5
    least_rho: float = 0.001
    most_rho: float = 0.2


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _two_label_suffix(host: Column) -> Column:
    last, second = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    return (F.length(last) == 2) & second.isin(*SECOND_LEVEL)


def domain_of(host: Column) -> Column:
    return F.when(_two_label_suffix(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(_two_label_suffix(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule's text, or null. Rules: (verdict, ``host/path``)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _rho(units: DataFrame, prior: str, settings: Reputation) -> float:
    """Correlation within units by moments: sums over all units come back as one row."""
    q = F.col(prior) * (1 - F.col(prior))
    row = units.agg(
        F.sum((F.col("k") - F.col("n") * F.col(prior)) ** 2 - F.col("n") * q).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * q).alias("weight"),
    ).first()
    raw = row["excess"] / row["weight"] if row["weight"] else settings.least_rho
    return min(max(raw, settings.least_rho), settings.most_rho)


def host_reputation(pages: DataFrame, outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """One row for each labelled host: host, n, k, mean, bound. ``pages``: page_id, host; ``outcomes``: page_id, bad (0, 1 or null)."""
    return every_reputation(pages, outcomes, settings).where("n > 0").drop("pages")


def every_reputation(pages: DataFrame, outcomes: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """As ``host_reputation``, with a row for each host of ``pages`` and its number of pages; without outcomes n and k are 0."""
    shared, sums = Shared(pages.sparkSession, "reputation"), [F.sum(c).alias(c) for c in ("n", "k")]
    known = pages.select("page_id", "host").join(outcomes.select("page_id", "bad").where("bad IS NOT NULL"), "page_id", "left")
    hosts = known.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = shared.write(hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    domains = shared.write(hosts.groupBy("domain", "suffix").agg(*sums, F.count("*").alias("below")), "domains")
    suffixes = shared.write(domains.groupBy("suffix").agg(*sums, F.count("*").alias("below")), "suffixes")
    total = suffixes.agg(*sums, F.sum("below").alias("domains")).first()
    root = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(units: DataFrame) -> DataFrame:
        m = 1 / _rho(units, "prior", settings) - 1
        return units.withColumn("m", F.lit(m)).withColumn("mean", (F.col("k") + m * F.col("prior")) / (F.col("n") + m))

    def under(units: DataFrame, parents: DataFrame, key: str, most: int) -> DataFrame:
        return with_facts(units, parents.select(key, F.col("mean").alias("prior"), F.col("below").alias("siblings")), [key], "siblings", most).drop("siblings")

    suffixes = shrunk(suffixes.withColumn("prior", F.lit(root)))
    domains = shared.write(shrunk(under(domains, suffixes, "suffix", total["domains"] or 0)), "shrunk-domains")
    hosts = shrunk(under(hosts, domains, "domain", hosts.count()))
    a, b = F.col("k") + F.col("m") * F.col("prior"), F.col("n") - F.col("k") + F.col("m") * (1 - F.col("prior"))
    bound = F.col("mean") - settings.z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    out = shared.write(hosts.select("host", "pages", "n", "k", "mean", bound.alias("bound")), "reputation")
    shared.keep("reputation")
    return out


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), settings: Reputation = Reputation()) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, bound. ``pages``: page_id, url; ``outcomes``: page_id, bad (0, 1 or null)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    reputation = every_reputation(parts, outcomes, settings)
    total = reputation.agg(F.sum("pages")).first()[0] or 0
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else F.lit(None).cast("map<string,string>")
    judged = with_facts(parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)), reputation.select("host", "pages", "bound"), ["host"], "pages", total)
    method = F.when(F.col("bound") > settings.limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(verdicts, F.col("rule")), method).alias("verdict"), "bound")
