"""URL filters: listed rules first, then an empirical-Bayes reputation of hosts.

Everything is DataFrame functions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: (host, path, verdict).  A rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: A host is blocked where the lower posterior bound of its share of bad pages is above this.
BAD_SHARE = 0.5
#: Width of the bound in posterior standard deviations (about 5 % in the lower tail).
Z = 1.645
#: Limits of the estimated prior strength, in pseudo pages.
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.char_length(url))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does.  Equally long rules: the first listed."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def registered_domain(host: Column) -> Column:
    """The last two labels without a port; there is no public-suffix list here, so every suffix counts as one label."""
    return F.substring_index(F.regexp_replace(host, r":\d*$", ""), ".", -2)


def suffix(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)


def _strength(level: DataFrame) -> tuple[float, float]:
    """Overall share and prior strength of a level's beta distribution by moments, from one row of sums."""
    n, b = F.col("n"), F.col("b")
    r = level.filter(n > 0).agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(b).alias("b"), F.sum(n * n).alias("n2"), F.sum(b * b / n).alias("bb")).first()
    if not r["k"]:
        return 0.0, STRENGTH[0]
    p = r["b"] / r["n"]
    spread = r["bb"] - r["n"] * p * p
    free = r["n"] - r["n2"] / r["n"]
    between = (spread - (r["k"] - 1) * p * (1 - p)) / free if free > 0 else 0.0
    m = p * (1 - p) / between - 1 if between > 0 else STRENGTH[1]
    return p, min(max(m, STRENGTH[0]), STRENGTH[1])


def reputations(outcomes: DataFrame) -> DataFrame:
    """outcomes: host, bad (0, 1 or null for an unlabelled page).  Per host: n, b, share, bound.

    Beta-binomial shrinkage in three steps: a suffix towards all pages, a registered domain towards its suffix, a host
    towards its domain.  The strength of each step is estimated from the level's own spread.  A hot host is one row of
    partial sums per task; hosts without labels get their domain's posterior.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    (p0, ms), (_, md), (_, mh) = _strength(suffixes), _strength(domains), _strength(hosts)
    s = suffixes.select("suffix", ((F.col("b") + ms * p0) / (F.col("n") + ms)).alias("p_suffix"))
    d = domains.join(s, "suffix").select("domain", ((F.col("b") + md * F.col("p_suffix")) / (F.col("n") + md)).alias("p_domain"))
    a = F.col("b") + mh * F.col("p_domain")
    total = F.col("n") + mh
    share = a / total
    return hosts.join(d, "domain").select("host", "n", "b", share.alias("share"), (share - Z * F.sqrt(share * (1 - share) / (total + 1))).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_share: float = BAD_SHARE) -> DataFrame:
    """A verdict for every row of pages (page_id, url).

    Nulls: a null or malformed url has an empty host and path and is judged by the reputation of the empty host.
    Repeated rows are judged one by one; an empty table gives an empty result; other columns are left out.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rep = reputations(outcomes)
    hit = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > bad_share, "block").otherwise("allow")
    return (
        p.join(rep, "host", "left")
        .withColumn("hit", hit)
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "share", "bound")
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled page outcomes: the last number in a page's path is the id of the labelled document shown there.

    A page is bad if any label row of its document says toxic or low quality; pages without a label keep a null.
    """
    key = F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})\D*$", 1).try_cast("long")
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    p = pages.select(host_of(F.col("url")).alias("host"), key.alias("doc_id"))
    return p.join(bad, "doc_id", "left").select("host", "bad")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")
