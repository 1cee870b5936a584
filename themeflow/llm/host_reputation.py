"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes (1 = bad) are counted per host, registered domain and
suffix. Every level is a beta-binomial population: its prior mean is the
posterior mean of the level above (the whole corpus above suffixes), its prior
strength is estimated from the spread of the observed rates around those means
by the method of moments. So a host with few labels is judged by its domain, a
domain by its suffix. A page is blocked if the posterior of its host's bad rate
lies above ``bad_rate`` with its lower bound, mean - z standard deviations.
Without any label nothing is blocked. Explicit rules (host, path prefix) come
before the method.

Counts are partial sums per host, so a very common host is one row per task;
only (host, verdict) rows join back to the pages.

Urls: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A null url or
one without ``://`` has neither; such pages form one host "" of their own.
Labels join by id: rows with a null id or label have no outcome, repeated label
rows count once each. Pages are judged row by row, also repeated ones. Other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.stored import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names that make a registry suffix with a country code.
REGISTRY_SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationSettings:
    rules: tuple[UrlRule, ...] = (
        UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
        UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
    bad_rate: float = 0.3
    z: float = 1.645
    strengths: tuple[float, float] = (1.0, 1000.0)
    #: Used where a level has no spread to estimate from.
    plain_strength: float = 20.0
    levels: tuple[str, ...] = field(default=("suffix", "domain", "host"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last name of the host, or the last two under a country registry."""
    second = F.element_at(F.split(host, "\\."), -2)
    last = F.element_at(F.split(host, "\\."), -1)
    double = second.isin(*REGISTRY_SECOND) & (F.length(last) == 2) & (F.size(F.split(host, "\\.")) > 2)
    return F.when(F.size(F.split(host, "\\.")) < 2, last).when(
        double, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more name in front (or the host itself)."""
    names = F.size(F.split(host, "\\."))
    keep = F.size(F.split(suffix, "\\.")) + 1
    return F.when(names <= keep, host).otherwise(F.array_join(
        F.slice(F.split(host, "\\."), names - keep + 1, keep), "."))


def by_rule(host: Column, path: Column, rules: tuple[UrlRule, ...], value) -> Column:
    """``value`` of the longest fitting rule; null if none fits."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(value(r))).otherwise(found)
    return found


def posterior(counts: DataFrame, s: ReputationSettings) -> DataFrame:
    """Per host: labelled pages, bad ones, and the posterior mean and bound.
    ``counts`` has host, domain, suffix, n, bad."""
    whole = counts.agg(F.when(F.sum("n") > 0, (F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))
    least, most = s.strengths
    out = counts.withColumn("prior", F.coalesce(whole.scalar(), F.lit(0.0)))
    for level in s.levels:
        groups = out.groupBy(level).agg(F.sum("n").alias("gn"), F.sum("bad").alias("gbad"),
                                        F.max("prior").alias("prior"))
        # E sum n (rate - prior)^2 = sum p(1-p) (1 + (n - 1) rho), rho = 1 / (strength + 1)
        pq = F.col("prior") * (1 - F.col("prior"))
        spread = groups.filter("gn > 0").agg(
            F.sum(F.col("gn") * F.pow(F.col("gbad") / F.col("gn") - F.col("prior"), 2)).alias("seen"),
            F.sum(pq).alias("even"), F.sum(pq * (F.col("gn") - 1)).alias("slope"))
        rho = (F.col("seen") - F.col("even")) / F.col("slope")
        strength = F.when(F.col("slope") > 0, F.when(
            rho > 0, F.least(F.lit(most), F.greatest(F.lit(least), 1 / rho - 1))).otherwise(F.lit(most))
        ).otherwise(F.lit(s.plain_strength))
        strength = spread.select(strength.alias("strength")).scalar()
        means = (groups.withColumn("strength", F.coalesce(strength, F.lit(s.plain_strength)))
                 .select(F.col(level).alias("__group"), "strength",
                         ((F.col("gbad") + F.col("strength") * F.col("prior"))
                          / (F.col("gn") + F.col("strength"))).alias("mean")))
        out = out.join(means, F.col(level) == F.col("__group"), "inner").drop("__group", "prior")
        out = out.withColumnRenamed("mean", "prior").withColumnRenamed("strength", f"strength_{level}")
    mean, weight = F.col("prior"), F.col("n") + F.col(f"strength_{s.levels[-1]}")
    return out.select("host", "n", "bad", mean.alias("bad_mean"),
                      (mean - s.z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, s: ReputationSettings = ReputationSettings(),
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and its host's labelled
    pages and posterior. ``outcomes`` has ``id_col`` and bad (0 or 1)."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))
    seen = outcomes.select(F.col(id_col).alias("__id"), F.col("bad").cast("long").alias("bad")).dropna()
    labelled = parsed.join(seen, parsed.page_id == F.col("__id"), "left")
    counts = (labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
              .withColumn("suffix", suffix_of(F.col("host")))
              .withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    counts = store(counts, "host-counts")
    hosts = posterior(counts, s).withColumnRenamed("host", "__host")
    judged = parsed.join(hosts, F.col("host") == F.col("__host"), "left")
    own = F.when(F.col("bad_bound") > s.bad_rate, "block").otherwise("allow")
    rule = by_rule(F.col("host"), F.col("path"), s.rules, lambda r: r.name)
    verdict = F.coalesce(by_rule(F.col("host"), F.col("path"), s.rules, lambda r: r.verdict), own)
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                         F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"))
