"""URL filters: rules first, then empirical-Bayes host reputation, in DataFrame operations only.

Rules are host and path prefixes; the longest fitting rule decides.  A page
that no rule fits is judged by its host: labelled outcomes are counted by host
and shrunk through beta-binomial priors, host to registered domain to suffix to
all.  How strongly a level is drawn to its parent is estimated from all data
(the spread between siblings beyond binomial noise).  A host is blocked if the
upper posterior bound of its share of good pages is below ``threshold``.

Edge cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged by the overall share; without any outcome every such page
is allowed; a host without a dot is its own domain and suffix; repeated rows
each give their row and count as outcomes each; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from .decontaminate import LOWER, UPPER, few

# Verdict and rule (host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
# Suffixes of two labels.
SECOND_LEVEL = ["ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk"]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own, _, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(SECOND_LEVEL), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def pull(children: DataFrame) -> float:
    """children: n, k and the parent's share m.  Prior weight by moments: n(p - m)^2 sums to the sum of m(1 - m)(1 + (n - 1) r)."""
    noise = F.col("m") * (1 - F.col("m"))
    row = children.where("n > 0").agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) ** 2).alias("s"), F.sum(noise).alias("a"), F.sum(noise * (F.col("n") - 1)).alias("b")).first()
    r = (row["s"] - row["a"]) / row["b"] if row["b"] else 0.5
    return 1 / min(max(r, 0.001), 0.999) - 1


def reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, dict]:
    """outcomes: host, good (0 or 1).  Of every host: host, n, mean and bounds low, high of its share of good pages; and the
    bounds of a host not seen, with all levels' figures."""
    shared_checkpoints(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k").checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    share = lambda w: (F.col("k") + w * F.col("m")) / (F.col("n") + w)
    suffixes = suffixes.withColumn("m", F.lit(root))
    w1 = pull(suffixes)
    suffixes = suffixes.select("suffix", share(w1).alias("m"))
    domains = domains.join(suffixes, "suffix").checkpoint()
    w2 = pull(domains)
    domains = domains.select("domain", share(w2).alias("m"))
    hosts = hosts.drop("suffix").join(domains, "domain").checkpoint()
    w3 = pull(hosts)
    mean, weight = share(w3), F.col("n") + w3
    sd = F.sqrt(mean * (1 - mean) / (weight + 1))
    unseen = (root * (1 - root) / (w1 + 1)) ** 0.5
    figures = {"root": root, "pulls": (w1, w2, w3), "low": root - z * unseen, "high": root + z * unseen}
    return hosts.select("host", "n", mean.alias("mean"), (mean - z * sd).alias("low"), (mean + z * sd).alias("high")), figures | {"suffixes": suffixes, "domains": domains}


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and posterior (the host's mean; null where a rule decides).  outcomes: host, good;
    without them the pages that rules judge are the labelled ones (allowed is good)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    if outcomes is None:
        outcomes = ruled.where("rule is not null").select("host", (F.col("says") == "allow").cast("int").alias("good"))
    hosts, figures = reputation(outcomes)
    open_hosts = ruled.where("rule is null").select("host").distinct()
    # hosts without an outcome of their own fall back to their domain, suffix or all
    known = open_hosts.join(hosts.select("host", "mean", "high"), "host", "left")
    known = known.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = known.join(figures["domains"].select("domain", F.col("m").alias("dm")), "domain", "left").join(figures["suffixes"].select("suffix", F.col("m").alias("sm")), "suffix", "left")
    prior, w = F.coalesce("dm", "sm", F.lit(figures["root"])), figures["pulls"][2]
    bound = prior + 1.645 * F.sqrt(prior * (1 - prior) / (w + 1))
    verdicts = known.select(F.col("host").alias("open_host"), F.coalesce("mean", prior).alias("posterior"), F.coalesce("high", bound).alias("high")).checkpoint()
    verdicts = few(verdicts, verdicts.count())
    by_method = F.when(F.coalesce("high", F.lit(1.0)) < threshold, "block").otherwise("allow")
    # pages that rules decide stay out of the join: they have no key in it
    decided = ruled.where("rule is not null").select("page_id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("double").alias("posterior"))
    open_pages = ruled.where("rule is null").join(verdicts, F.col("host") == F.col("open_host"), "left")
    return decided.unionByName(open_pages.select("page_id", "host", "path", "rule", by_method.alias("verdict"), "posterior"))
