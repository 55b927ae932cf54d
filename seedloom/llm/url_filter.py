"""URL filter: explicit rules, else the reputation of the host by empirical Bayes.

Labelled page outcomes (bad or not) are counted per host. A host's rate of bad pages
has a beta prior whose mean is the posterior mean of its registered domain, whose prior
mean is that of its suffix, whose prior mean is that of all labelled pages. The strength
of each prior is the method-of-moments estimate of the beta-binomial at that level. A
host is blocked if the lower posterior bound of its rate exceeds the limit.

Only DataFrame operations; what reaches the driver are single rows of sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    """``host/path`` with what to do: fits the host and its subdomains where the url's path starts with the rule's."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: More rules than this go into a table of their own, which pages are joined with; fewer are a literal of the plan.
MOST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The label before the suffix, with the suffix; a host of one label is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (length, rule, verdict), or null. Of equally long ones, the last by code point."""
    if not rules:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)

    def entry(r: Rule) -> Column:
        return F.struct(F.lit(len(r.rule)).alias("length"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))

    listed = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at_hosts = F.filter(F.transform(suffixes, lambda h: F.try_element_at(listed, h)), lambda x: x.isNotNull())
    fitting = F.filter(F.flatten(at_hosts), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def matched_by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (host, path, ...) with ``best`` as ``matched_rule`` has it, for any number of rules (rule, verdict): each distinct host and path meets the rules
    of its host and of the domains above it in a join."""
    rule = F.col("rule")
    own = rules.where(rule.isNotNull()).select(
        F.lower(F.substring_index(rule, "/", 1)).alias("_at"),
        F.concat(F.lit("/"), F.when(F.contains(rule, F.lit("/")), F.substring(rule, F.instr(rule, F.lit("/")) + 1, F.length(rule))).otherwise("")).alias("_path"),
        F.struct(F.length(rule).alias("length"), rule.alias("rule"), F.col("verdict").cast("string").alias("verdict")).alias("_best"),
    )
    labels = F.split(F.col("host"), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = pages.select("host", "path").distinct().withColumn("_at", F.explode(above))
    best = named.join(own, "_at").where(F.startswith(F.col("path"), F.col("_path"))).groupBy("host", "path").agg(F.max("_best").alias("best"))
    return pages.join(best, ["host", "path"], "left")


def _strength(groups: DataFrame, low: float, high: float) -> float:
    """Prior strength from rows (n, bad, prior mean): 1/rho - 1 for the moment estimate of the correlation rho within a group."""
    within = F.col("mean") * (1 - F.col("mean"))
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), F.lit(2.0)) - within).alias("over"),
        F.sum((F.col("n") - 1) * within).alias("room"),
    ).first()
    rho = row["over"] / row["room"] if row["room"] else low
    rho = min(max(rho, low), high)
    return 1 / rho - 1


def reputation(hosts: DataFrame, z: float = 1.645, least_rho: float = 0.001, most_rho: float = 0.5) -> DataFrame:
    """hosts: host, n (labelled pages), bad (those that are bad) -> host, rate, bound.

    rate is the posterior mean and bound the lower posterior bound (mean minus z standard
    deviations of the beta posterior). Hosts without labels get their domain's rate.
    """
    named = stored(hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = named.agg(*sums).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(groups: DataFrame) -> DataFrame:
        k = _strength(groups, least_rho, most_rho)
        return groups.withColumn("rate", (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)).withColumn("k", F.lit(k))

    suffixes = shrunk(named.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall)))
    domains = stored(named.groupBy("suffix", "domain").agg(*sums), "domains")
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("mean")), "suffix"))
    at_host = shrunk(named.join(domains.select("domain", F.col("rate").alias("mean")), "domain"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("k") + 1))
    return at_host.select("host", "rate", (F.col("rate") - z * deviation).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] | DataFrame, limit: float = 0.5, z: float = 1.645, least_rho: float = 0.001, most_rho: float = 0.5
) -> DataFrame:
    """pages: page_id, url, item (what ``outcomes`` calls the page); outcomes: item, bad (0/1; any number of rows an item).

    Returns page_id, host, path, rule, verdict, rate, bound for each row of ``pages``. ``rules`` may be a table (rule, verdict).

    * A null url, or one without ``://``, has an empty host and path: no rule but those for
      the empty host fit, and its reputation is that of all such pages.
    * An item with several outcomes is bad if any is; null outcomes are none.
    * Repeated pages count, and are judged, once per row; an empty table gives no rows.
    """
    parsed = pages.select("page_id", "item", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("bad is not null and item is not null").groupBy("item").agg(F.max("bad").cast("long").alias("bad"))
    hosts = parsed.join(known, "item", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known_hosts = stored(reputation(hosts, z, least_rho, most_rho), "reputation")
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame([(r.rule, r.verdict) for r in rules], "rule string, verdict string")
    named = parsed.drop("item").join(known_hosts, "host", "left")
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return (
        (matched_by_join(named, rules) if isinstance(rules, DataFrame) else named.withColumn("best", matched_rule(F.col("host"), F.col("path"), rules)))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), by_method).alias("verdict"), "rate", "bound")
    )
