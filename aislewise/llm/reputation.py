"""URL filter: host reputation by empirical Bayes, under longest-match rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import join_counted

#: (verdict, host, path prefix): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of more than one label under which domains are registered; all others are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
#: A host is blocked when the lower bound of its bad rate, Z posterior deviations below the mean, is over MAX_BAD.
MAX_BAD, Z = 0.5, 1.645
#: Prior strength (pseudo-pages) is kept inside these bounds; without a measurable spread it is the upper one.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null if none does."""
    text = verdict = None
    for kind, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        text = F.when(fits, name + prefix) if text is None else text.when(fits, name + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(list(suffixes)), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _prior(n: Column, bad: Column) -> tuple[Column, Column]:
    """Sums from which a level's prior mean and strength follow by moments: (mean, strength) as aggregates."""
    total, groups = F.sum(n), F.count("*")
    mean = F.sum(bad) / total
    # moments of a beta-binomial: between-group variance over what binomial noise alone would give
    between = F.sum(bad * bad / n) / total - mean * mean
    noise = mean * (1 - mean)
    k = total / groups
    rho = F.when(noise > 0, F.greatest(F.lit(0.0), (between / noise * k - 1) / F.greatest(k - 1, F.lit(1e-9)))).otherwise(F.lit(0.0))
    strength = F.when(rho > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MOST_STRENGTH))
    return mean, strength


def reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, mean, lower for each row of hosts (host, n, bad: labelled pages and the bad ones among them, 0 for none).

    Suffix rates are drawn to the rate of all pages, domain rates to their suffix's posterior mean, host rates to their
    domain's; the strength of each pull is the beta-binomial prior's, fitted by moments over the labelled groups of
    that level. So a host without labels has its domain's rate, a domain without labels its suffix's, a suffix without
    labels that of all pages, each with the prior's spread. Without any label mean and lower are null.
    """
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"), F.count("*").alias("dhosts"))
    ends = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"), F.count("*").alias("sdomains"))

    def level(df: DataFrame, n: str, bad: str, p: str) -> DataFrame:
        mean, strength = _prior(F.col(n), F.col(bad))
        return df.where(F.col(n) > 0).agg(mean.alias(f"{p}mean"), strength.alias(f"{p}k"))

    one = F.broadcast(level(hosts, "n", "bad", "h").crossJoin(level(domains, "dn", "dbad", "d")).crossJoin(level(ends, "sn", "sbad", "s")))  # a single row
    ends = ends.crossJoin(one).select("suffix", "sdomains", ((F.col("sbad") + F.col("sk") * F.col("smean")) / (F.col("sn") + F.col("sk"))).alias("sp"), "dk", "hk")
    rates = join_counted(domains, ends, "suffix", "sdomains")
    rates = rates.select("domain", "dhosts", ((F.col("dbad") + F.col("dk") * F.col("sp")) / (F.col("dn") + F.col("dk"))).alias("dp"), "hk")
    a, b = F.col("bad") + F.col("hk") * F.col("dp"), F.col("n") - F.col("bad") + F.col("hk") * (1 - F.col("dp"))
    post = join_counted(hosts, rates, "domain", "dhosts").select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
    return post.select("host", "mean", F.greatest(F.lit(0.0), F.col("mean") - Z * F.col("sd")).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_rate_lower for each row of pages (page_id, url).

    outcomes: page_id, bad (0/1); rows of one page are one outcome, bad if any is. suffixes: those of more than one
    label, such as a public list has. A null url has empty host and path and no rule. Every host is judged, also one
    without labelled pages: by its domain's, its suffix's or all pages' rate. Urls without a host are no host's pages:
    their bad_rate is null, they are neither learned from nor blocked by the method. Without labels nothing is. Repeated
    rows each give a row. Other columns are not read.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = parsed.where("host <> ''").join(once, "page_id", "left").groupBy("host")
    counts = counted.agg(F.count("*").alias("pages"), F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    counts, _ = common.stored(counts, "hosts")
    known = reputation(counts.select("host", "n", "bad"), suffixes).join(counts.select("host", "pages"), "host")
    known, _ = common.stored(known.select("host", F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"), "pages"), "reputation")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_rate_lower") > max_bad, "block").otherwise("allow")
    judged = join_counted(parsed.where("host <> ''"), known, "host", "pages").drop("pages")
    none = F.lit(None).cast("double")
    judged = judged.unionByName(parsed.where("host = ''").withColumns({"bad_rate": none, "bad_rate_lower": none}))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_rate_lower")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose id is the page's; bad if of low quality or toxic. Repeated pages repeat, null urls have no host."""
    labels = common.table(spark, sf_dir, "labels")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    out = judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    rounded = {c: F.round(c, 6) for c in ("bad_rate", "bad_rate_lower")}
    return out.withColumns(rounded)


_LEVEL = """
 SELECT sum(b) / sum(n) AS mean, CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END AS k
 FROM {t}, LATERAL (SELECT CASE WHEN z > 0 THEN greatest(0.0, (w / z * kk - 1) / greatest(kk - 1, 1e-9)) ELSE 0.0 END AS rho
   FROM (SELECT sum(b * b / n) / sum(n) - (sum(b) / sum(n)) ** 2 AS w, (sum(b) / sum(n)) * (1 - sum(b) / sum(n)) AS z,
     sum(n) / count(*) AS kk FROM {t} WHERE n > 0)) WHERE n > 0 GROUP BY rho"""
SQL = rf"""
WITH parsed AS (
 SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
once AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
 FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b,
  CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {SUFFIXES} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
  CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {SUFFIXES} THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix
 FROM parsed LEFT JOIN once USING (page_id) WHERE host <> '' GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY 1),
h0 AS ({_LEVEL.format(t='hosts')}), d0 AS ({_LEVEL.format(t='domains')}), s0 AS ({_LEVEL.format(t='suffixes')}),
sp AS (SELECT suffix, (b + k * mean) / (n + k) AS p FROM suffixes, s0),
dp AS (SELECT domain, (domains.b + k * sp.p) / (domains.n + k) AS p FROM domains JOIN sp USING (suffix), d0),
ab AS (SELECT host, hosts.b + k * dp.p AS a, hosts.n - hosts.b + k * (1 - dp.p) AS c FROM hosts JOIN dp USING (domain), h0),
known AS (SELECT host, a / (a + c) AS bad_rate, greatest(0.0, a / (a + c) - {Z} * sqrt(a * c / ((a + c) * (a + c) * (a + c + 1)))) AS bad_rate_lower FROM ab),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bad_rate_lower > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict, round(bad_rate, 6) AS bad_rate, round(bad_rate_lower, 6) AS bad_rate_lower
FROM ruled LEFT JOIN known USING (host)
"""
QUERIES = {"op5_url_reputation": query}
