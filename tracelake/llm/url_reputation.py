"""URL filters: explicit rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted for each host, registered domain and suffix.
Each level's good rates are taken as draws of a beta distribution around the
level above; its strength comes from the method of moments.  A host's posterior
is its own counts on top of its domain's posterior mean, and so on upwards; a
host is blocked when the upper bound of its good rate lies under ``min_rate``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; any other host's suffix is its last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: (verdict, host, path prefix) of the default rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_RATE = 0.5
BOUND_Z = 1.645
#: Bounds of the intra-class correlation, so that strengths lie between 1 and 999.
MIN_RHO, MAX_RHO = 0.001, 0.5


def host_of(url: Column) -> Column:
    """Host, A-Z lower-cased; empty for null and for a url without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, at + prefix).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _strength(nodes: DataFrame) -> DataFrame:
    """One row: pooled rate and the beta strength of ``nodes`` (good, n), by moments."""
    sums = nodes.where("n > 0").agg(
        F.sum("good").alias("good"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("g2"),
        F.count("*").alias("nodes"),
    )
    total, rate = F.col("n").cast("double"), F.col("rate")
    spread = rate * (1 - rate)
    between = (F.col("g2") - total * rate * rate - (F.col("nodes") - 1) * spread) / (total - F.col("n2") / total)
    rho = F.when((spread > 0) & (total > F.col("n2") / total), F.try_divide(between, spread)).otherwise(F.lit(MIN_RHO))
    return sums.withColumn("rate", F.coalesce((F.col("good") + 1.0) / (F.col("n") + 2.0), F.lit(0.5))).select(
        "rate", (1 / F.greatest(F.lit(MIN_RHO), F.least(F.lit(MAX_RHO), F.coalesce(rho, F.lit(MIN_RHO)))) - 1).alias("strength")
    )


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, good, n, posterior_mean, upper) of every host of ``pages``.

    ``outcomes`` has page_id and good (0 or 1, null: unlabelled).  Hosts without
    outcomes take their domain's posterior, new domains their suffix's.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"))
    good = (
        outcomes.select("page_id", F.col("good").cast("int").alias("good"))
        .where("page_id IS NOT NULL AND good IN (0, 1)")
        .groupBy("page_id")
        .agg(F.max("good").alias("good"))
    )
    hosts = (
        urls.join(good, "page_id", "left")
        .groupBy(suffix_of(F.col("host")).alias("suffix"), domain_of(F.col("host")).alias("domain"), "host")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"))
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    strengths = [
        _strength(x).select(F.col("rate").alias(f"rate{i}"), F.col("strength").alias(f"k{i}"))
        for i, x in enumerate((suffixes, domains, hosts))
    ]
    shrunk = lambda mean, k: ((F.col("good") + F.col(k) * F.col(mean)) / (F.col("n") + F.col(k)))
    # Each of the three strength tables is an aggregate without keys: one row by construction.
    top = suffixes.join(F.broadcast(strengths[0])).select("suffix", shrunk("rate0", "k0").alias("suffix_mean"))
    middle = (
        domains.join(top, "suffix").join(F.broadcast(strengths[1])).select("domain", shrunk("suffix_mean", "k1").alias("domain_mean"))
    )
    a = F.col("good") + F.col("k2") * F.col("domain_mean")
    size = F.col("n") + F.col("k2")
    mean = F.col("posterior_mean")
    return (
        hosts.join(middle, "domain")
        .join(F.broadcast(strengths[2]))
        .select("host", "good", "n", (a / size).alias("posterior_mean"), size.alias("size"))
        .withColumn("upper", F.least(F.lit(1.0), mean + BOUND_Z * F.sqrt(mean * (1 - mean) / (F.col("size") + 1))))
        .drop("size")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_rate: float = MIN_RATE,
) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, posterior_mean, upper.

    A null url, or one without ``://``, has an empty host and path and is judged
    by the empty host's reputation.  Repeated rows each get a row; an empty table
    gives an empty table; without outcomes the prior rate is one half and every
    upper bound is at least ``min_rate``, so all is allowed.  A host that holds
    many of the pages is counted with partial sums, and the last join sees plain
    exchanges on both sides, so that a skewed host is split.
    """
    known = reputations(pages, outcomes).select(
        "host", F.round("posterior_mean", 6).alias("posterior_mean"), F.round("upper", 6).alias("upper")
    )
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, decision = match_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("upper") < min_rate, "block").otherwise("allow")
    return urls.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(decision, by_method).alias("verdict"), "posterior_mean", "upper"
    )
