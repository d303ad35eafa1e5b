"""URL filter: rules, then empirical-Bayes host reputation, on DataFrame functions alone.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's rates are shrunk towards the
level above by a beta-binomial prior whose strength is estimated from that level's spread (moments): the suffix
towards the overall rate, the domain towards its suffix, the host towards its domain. A page without a rule is
blocked if the upper bound of its host's posterior lies below the least good rate: unknown hosts keep their prior.

Counts are partial aggregates, so a host with any share of the pages is a few rows after the first exchange; the join
back to the pages is one that AQE can split.

Cases: a null url, or one without ://, has an empty host and path and is judged by the prior of its (empty) suffix;
null ids have no outcome; several labels of a page count once, the worst; repeated pages each give their row; without
labels nothing is blocked by the method; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import LOWER, UPPER, Scratch

#: Fixed values: (verdict, rule as host/path-prefix).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Common suffixes of two labels. A fuller list of public suffixes is a parameter of `judge`.
WIDE = [
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
]
#: Least good rate, standard deviations of the bound, and limits of a prior's strength.
LEAST, Z, STRENGTH = 0.5, 1.645, (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, NULL without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked first
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, wide: list[str] = WIDE) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(wide), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column, wide: list[str] = WIDE) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(wide), two).otherwise(F.substring_index(host, ".", -1))


def _strength(children: DataFrame) -> float:
    """Moment estimate of the prior's strength for children (n, good, above): one aggregated row.

    For a rate p of n outcomes with mean m above it, (p - m)^2 expects m (1 - m) (1/n + (1 - 1/n) / (s + 1)).
    """
    v = F.col("above") * (1 - F.col("above"))
    gap = F.pow(F.col("good") / F.col("n") - F.col("above"), 2) - v / F.col("n")
    over, room = children.where("n >= 2").agg(F.sum(gap), F.sum(v * (1 - 1 / F.col("n")))).first()
    if not room or over is None:
        return STRENGTH[0]
    rho = over / room
    return STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


def reputations(pages: DataFrame, outcomes: DataFrame, scratch: Scratch, wide: list[str] = WIDE) -> DataFrame:
    """(host, n, good, mean, upper) for every host of pages (page_id, host); outcomes: (page_id, good 0/1)."""
    o = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").cast("double").alias("good"))
    hosts = pages.join(o, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
    hosts = scratch.keep(hosts.withColumns({"domain": domain_of(F.col("host"), wide), "suffix": suffix_of(F.col("host"), wide)}))
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = scratch.keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    overall = (good + 1) / (n + 1) if n else 1.0  # all good until an outcome says otherwise

    def shrunk(level: DataFrame) -> DataFrame:
        s = _strength(level)
        a, b = F.col("good") + s * F.col("above"), F.col("n") - F.col("good") + s * (1 - F.col("above"))
        mean = a / (a + b)
        return level.withColumns({"mean": mean, "deviation": F.sqrt(mean * (1 - mean) / (a + b + 1))})

    suffixes = shrunk(suffixes.withColumn("above", F.lit(float(overall))))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("above")), "suffix"))
    domains = scratch.keep(domains)
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("above")), "domain"))
    return scratch.keep(hosts.select("host", "n", "good", "mean", F.least(F.col("mean") + Z * F.col("deviation"), F.lit(1.0)).alias("upper")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, least: float = LEAST, wide: list[str] = WIDE) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) of every page (page_id, url); wide: suffixes of two labels."""
    scratch = Scratch(pages.sparkSession)
    p = scratch.keep(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    known = reputations(p, outcomes, scratch, wide).select("host", "mean", "upper")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < least, "block").otherwise("allow")
    return p.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.col("mean").alias("reputation"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from labels (doc_id, quality, toxic): a page counts as good if its document is good and not toxic."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
