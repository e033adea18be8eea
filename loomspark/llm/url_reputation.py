"""URL filtering by host reputation: beta-binomial shrinkage from host to registered domain to suffix.

Labelled pages are outcomes (bad or not) of their host. The rate of each suffix is shrunk towards the overall rate,
that of each registered domain towards its suffix, that of each host towards its domain; how strongly, is estimated
from the spread among the groups of that level (method of moments). A host is blocked where the lower posterior
bound of its bad rate is above the limit. Rules by host and path come first, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import materialize

#: (verdict, host and path); a rule fits its host and all subdomains where the url's path starts with its path.
RULES: list[tuple[str, str]] = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Second labels under which the registries of two-letter top domains hand out names, so that the suffix has two labels.
SECOND_LABELS = ["ac", "co", "com", "edu", "gov", "net", "ne", "or", "org"]
LONG_SUFFIX = rf"(^|\.)({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$"
ADDRESS = r"^([0-9.]+|\[.*)$"
LIMIT, BOUND_Z = 0.2, 1.645
RHO = (0.001, 0.999)

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host's name without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")


def suffix_of(name: Column) -> Column:
    """The part under which names are registered; an IP address, which has none, stands for itself."""
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(LONG_SUFFIX), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(LONG_SUFFIX), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; of equally long ones the first by text."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.find("/")
        h, p = (text[:at], text[at:]) if at >= 0 else (text, "")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _strength(groups: DataFrame, n: str, k: str, mean: str) -> float:
    """The prior's weight in observations, from how much more the groups spread than binomial ones would."""
    mu = F.col(mean)
    row = groups.agg(F.sum(F.pow(F.col(k) - F.col(n) * mu, F.lit(2.0)) - F.col(n) * mu * (1 - mu)).alias("a"), F.sum(F.col(n) * (F.col(n) - 1) * mu * (1 - mu)).alias("b")).first()
    rho = (row.a or 0.0) / row.b if row.b else RHO[1]
    rho = min(max(rho, RHO[0]), RHO[1])
    return 1 / rho - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, k, mean, lower, upper) of every host of outcomes (host, bad: 0 or 1).

    Hosts, domains and suffixes are groups of partial sums; only five sums a level come to the driver."""
    hosts = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    name = name_of(F.col("host"))
    hosts = materialize(hosts.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = suffixes.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    overall = (total.k + 0.5) / (total.n + 1.0) if total.n else 0.5
    suffixes = suffixes.withColumn("top", F.lit(overall))
    ms = _strength(suffixes, "sn", "sk", "top")
    suffixes = suffixes.select("suffix", ((F.col("sk") + ms * F.col("top")) / (F.col("sn") + ms)).alias("smean"))
    domains = domains.join(suffixes, "suffix")
    md = _strength(domains, "dn", "dk", "smean")
    domains = domains.select("domain", "suffix", ((F.col("dk") + md * F.col("smean")) / (F.col("dn") + md)).alias("dmean"))
    hosts = materialize(hosts.join(domains, ["domain", "suffix"]), "hosts")
    mh = _strength(hosts, "n", "k", "dmean")
    a, b = F.col("k") + mh * F.col("dmean"), F.col("n") - F.col("k") + mh * (1 - F.col("dmean"))
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", mean.alias("mean"), (mean - BOUND_Z * sd).alias("lower"), (mean + BOUND_Z * sd).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """pages (page_id, url, ...) plus host, path, rule, verdict and lower.

    outcomes: (page_id, bad) of the labelled pages. Null urls and urls without `://` have empty host and path, which
    is a host like any other. Hosts without labelled pages are allowed unless a rule blocks them. Rows without page_id
    are judged too; repeated rows each return a row; columns named like the added ones are replaced, all others come back
    as they are; an empty table gives an empty result. The bound is the posterior mean less BOUND_Z deviations, a normal
    approximation of the beta posterior's quantile."""
    new = ["host", "path", "rule", "verdict", "lower"]
    keep = [c for c in pages.columns if c not in new]
    original = [F.col(f"`{c}`") for c in keep]
    p = pages.select(*original, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = p.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id").where("bad is not null").select("host", "bad")
    known = reputations(seen).select("host", "lower")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    d = p.join(known, "host", "left")
    method = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return d.select(*original, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "lower")
