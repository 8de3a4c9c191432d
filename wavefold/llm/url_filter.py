"""URL filter by empirical-Bayes host reputation (operator 9).

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level is a beta-binomial whose prior mean is the posterior mean of
the level above and whose strength comes from the spread between the groups of
that level (method of moments). A page is blocked where the lower bound of its
host's posterior bad rate is above a threshold. Explicit rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.llm.shared import discard, light, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[Rule, ...] = ()
    #: Suffixes of more than one label (any list, such as a published one); any other host's suffix is its last label.
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
    #: Standard deviations below the posterior mean, and the bad rate that the bound must pass.
    z: float = 1.645
    threshold: float = 0.5
    #: Limits of the intra-group correlation 1 / (strength + 1).
    least_rho: float = 0.001
    most_rho: float = 0.5
    #: Hosts up to which their reputation is broadcast to the pages; beyond, the join is a shuffle that AQE splits at hot hosts.
    light_hosts: int = 500_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, long_suffixes: tuple[str, ...]) -> Column:
    """The longest known suffix of a host, else its last label."""
    out = F.substring_index(host, ".", -1)
    for n in sorted({s.count(".") + 1 for s in long_suffixes}):
        end = F.substring_index(host, ".", -n)
        out = F.when(end.isin(*[s for s in long_suffixes if s.count(".") + 1 == n]), end).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    rest = F.left(host, F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    return F.when(rest == "", host).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, ties to block; nulls if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame, cfg: UrlConfig) -> float:
    """Strength of a level's prior from the spread between its groups (n, bad), by the method of moments."""
    n, bad, nn, g, bbn = groups.filter("n > 0").agg(
        F.sum(F.col("n").cast("double")), F.sum(F.col("bad").cast("double")), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1)), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")),
    ).collect()[0]
    rho = cfg.least_rho
    if g and 0 < bad < n and (room := n - nn / n - (g - 1)) > 0:
        p = bad / n
        rho = ((bbn - bad * p) / (p * (1 - p)) - (g - 1)) / room
    return 1 / max(cfg.least_rho, min(cfg.most_rho, rho)) - 1


def host_reputation(outcomes: DataFrame, cfg: UrlConfig, folder: str) -> DataFrame:
    """host, n, bad, mean, bound from rows (host, n, bad): counts of each host.

    Hosts without outcomes take their domain's posterior as prior. Counts are
    written once; the levels above are summed from them, and a few sums of each
    level come to the driver.
    """
    o = outcomes.withColumn("suffix", suffix_of(F.col("host"), cfg.long_suffixes))
    hosts = written(o.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), folder, "hosts")
    summed = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(summed(hosts, "domain", "suffix"), folder, "domains")
    suffixes = written(summed(domains, "suffix"), folder, "suffixes")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).collect()[0]

    def mean(strength: float, parent: Column) -> Column:
        return (F.lit(strength) * parent + F.col("bad")) / (F.lit(strength) + F.col("n"))

    s = suffixes.select("suffix", mean(_strength(suffixes, cfg), F.lit((bad + 0.5) / (n + 1))).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", mean(_strength(domains, cfg), F.col("suffix_mean")).alias("domain_mean"))
    strength = _strength(hosts, cfg)
    h = hosts.join(d, "domain").select("host", "n", "bad", mean(strength, F.col("domain_mean")).alias("mean"))
    size = F.lit(strength) + F.col("n") + 1
    return h.withColumn("bound", F.col("mean") - cfg.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / size))


def filter_urls(pages: DataFrame, labels: DataFrame, cfg: UrlConfig, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the host's posterior.

    ``labels`` are rows (id, bad): outcomes of pages by page_id; several of one
    page all count, rows with a null id or outcome count nothing. A null url or
    one without ``://`` has an empty host and path, which form a host of their
    own. Repeated pages stay, each judged alike. Empty tables give no rows. The
    counts of hosts go to ``folder``; pages are read twice.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = labels.filter("id is not null and bad is not null").groupBy("id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = p.select("page_id", "host").join(seen, F.col("page_id") == F.col("id"), "left")
    outcomes = counted.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), cfg.rules)
    own = F.when(F.col("bound") > cfg.threshold, "block").otherwise("allow")
    reputation = written(host_reputation(outcomes, cfg, folder), folder, "reputation")
    discard(pages.sparkSession, folder, "hosts", "domains", "suffixes")
    return p.join(light(reputation, cfg.light_hosts), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_rate_bound"),
    )
