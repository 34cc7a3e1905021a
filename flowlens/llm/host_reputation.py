"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Rules decide first. For the other pages a host's share of bad outcomes is
shrunk through beta-binomial priors: the suffix (last label) towards all
pages, the registered domain (last two labels, or three under a listed
two-label suffix) towards its suffix, the host towards its domain. The
strength of each prior is estimated from the spread of the children around
their parents (moments of the beta-binomial). A page is blocked when the
posterior's lower bound (mean less ``z`` standard deviations) exceeds
``max_bad``.

Outcomes are counted by host with map-side partial aggregation; the tables of
hosts, domains and suffixes are joined to pages on the host, so a hot host is
one row there. Four rows of sums reach the driver.

Edge cases: null urls and urls without ``://`` have empty host and path, and
the empty host is a host like any other; hosts without outcomes have their
prior alone; without any outcome nothing is blocked but by rules; null
outcomes are none; repeated pages are judged each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import write_scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@dataclass(frozen=True)
class ReputationParams:
    rules: tuple[tuple[str, str], ...] = RULES
    two_label_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
    z: float = 1.645
    max_bad: float = 0.3
    least_spread: float = 1e-3
    most_spread: float = 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def domain_of(host: Column, two_label: tuple[str, ...]) -> Column:
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last = F.substring_index(bare, ".", -2)
    return (F.when(bare.rlike(r"^[0-9]+(\.[0-9]+){3}$"), bare)
            .when(last.isin(*two_label), F.substring_index(bare, ".", -3)).otherwise(last))


def _strength(children: DataFrame, p: ReputationParams) -> float:
    """Prior sample size kappa from the children's spread: rho = 1 / (kappa + 1)
    is the correlation of outcomes within a child. ``children``: n, bad and
    their parent's parent_n, parent_bad."""
    r = F.try_divide("bad", "n")
    q = F.try_divide("parent_bad", "parent_n")
    sums = (children.where("n > 0")
            .agg(F.sum(F.col("n") * (r - q) * (r - q)).alias("spread"), F.sum(q * (1 - q)).alias("chance"),
                 F.sum(q * (1 - q) * (F.col("n") - 1)).alias("pairs")).first())
    rho = (sums["spread"] - sums["chance"]) / sums["pairs"] if sums["pairs"] else p.least_spread
    rho = min(max(rho, p.least_spread), p.most_spread)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, params: ReputationParams | None = None) -> DataFrame:
    """``pages``: page_id, url. ``outcomes``: url, bad (0 or 1; null: none).
    Returns page_id, host, path, rule, verdict, bad_mean, bad_bound."""
    p = params or ReputationParams()
    seen = outcomes.select(host_of(outcomes["url"]).alias("host"), F.col("bad").cast("long").alias("bad")).where("bad is not null")
    named = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    counts = (named.select("host", F.lit(0).alias("k"), F.lit(0).cast("long").alias("bad")).unionByName(seen.select("host", F.lit(1).alias("k"), "bad"))
              .groupBy("host").agg(F.sum("k").alias("n"), F.sum("bad").alias("bad"))
              .transform(lambda d: write_scratch(d, "host-counts"))
              .withColumn("domain", domain_of(F.col("host"), p.two_label_suffixes)).withColumn("suffix", F.substring_index("domain", ".", -1)))
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    as_parent = lambda d, on: d.select(on, F.col("n").alias("parent_n"), F.col("bad").alias("parent_bad"))
    ks = _strength(suffixes.withColumns({"parent_n": F.lit(top["n"]), "parent_bad": F.lit(top["bad"])}), p)
    kd = _strength(domains.join(as_parent(suffixes, "suffix"), "suffix"), p)
    kh = _strength(counts.join(as_parent(domains, "domain"), "domain"), p)
    mean = (top["bad"] + 1) / (top["n"] + 2) if top and top["n"] else 0.0
    post = lambda k, m: (F.col("bad") + F.lit(k) * m) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", post(ks, F.lit(mean)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", post(kd, F.col("suffix_mean")).alias("domain_mean"))
    a = F.col("bad") + F.lit(kh) * F.col("domain_mean")
    total = F.col("n") + F.lit(kh)
    m = a / total
    hosts = (counts.join(domains, "domain")
             .select("host", F.round(m, 6).alias("bad_mean"),
                     F.round(m - F.lit(p.z) * F.sqrt(m * (1 - m) / (total + 1)), 6).alias("bad_bound")))
    rule = matched_rule(F.col("host"), F.col("path"), p.rules)
    verdicts = F.lit(None).cast("string")
    for r, v in p.rules:
        verdicts = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdicts)
    return (named.withColumn("rule", rule).join(hosts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce(verdicts, F.when(F.col("bad_bound") > p.max_bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "bad_mean", "bad_bound"))
