"""URL filters: explicit rules, else empirical-Bayes host reputation.

Labelled outcomes are counted for each host, and the bad rate of a host is
shrunk towards its registered domain, the domain's towards its public suffix and
the suffix's towards the rate of all, by beta priors. The strength of each
prior comes from the over-dispersion of the counts at its level (method of
moments for the beta-binomial). A page is blocked if the lower bound of its
host's posterior bad rate is above a limit. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path) of explicit rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels under which country domains register names: with a country's two letters they are one suffix, as in ``gov.uk`` or ``com.cn``.
CATEGORY_LABELS = ("ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Other suffixes of two labels, to be given for registries with names of their own; every other suffix is the last label.
MORE_SUFFIXES: tuple[str, ...] = ()
#: What hosts have as suffix that are addresses, not names.
ADDRESSES = "#"
#: Parts of a suffix's domains, which may be a third of all: its row meets each part in a task of its own.
SUFFIX_PARTS = 32
#: One-sided 95 % bound, and the bad rate that it must exceed to block.
Z, BAD_RATE_LIMIT = 1.6448536269514722, 0.5
#: Bounds of the intra-class correlation, 1 / (prior strength + 1).
RHO_LOW, RHO_HIGH = 0.001, 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path; both are empty for a null url and for one without ``://``."""
    at = pages.withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    rest = F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) ELSE '' END")
    return at.withColumns({"host": host_of(F.col("_url")), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}).drop("_url")


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path, as ``net/``) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _levels(host: Column, more: tuple[str, ...] = MORE_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user, port and final dots; an IP address is a domain of its own."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[0-9]*)?$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    double = last(2).rlike(rf"^({'|'.join(CATEGORY_LABELS)})\.[a-z][a-z]$")
    if more:
        double = double | last(2).isin(*more)
    address = name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    domain, suffix = F.when(double, last(3)).otherwise(last(2)), F.when(double, last(2)).otherwise(last(1))
    return F.when(address, name).otherwise(domain), F.when(address, ADDRESSES).otherwise(suffix)


def host_reputation(outcomes: DataFrame, z: float = Z, more: tuple[str, ...] = MORE_SUFFIXES) -> DataFrame:
    """(host, n, bad, bad_rate, lower) for every host of ``outcomes`` (host, bad: 0, 1 or null for no label)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("x"))
    domain, suffix = _levels(F.col("host"), more)
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")))
    suffixes = cut(hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("x").alias("sx")))
    total = suffixes.agg(F.sum("sn"), F.sum("sx")).first()
    n, x = float(total[0] or 0), float(total[1] or 0)
    p = (x + 1) / (n + 2)

    def strength(level: DataFrame, count: str, bad: str) -> float:
        c, b = F.col(count), F.col(bad)
        k, s = level.filter(c > 0).agg(F.count(F.lit(1)), F.sum(c * (b / c - p) * (b / c - p))).first()
        rho = (s / (p * (1 - p)) - k) / (n - k) if k and n > k else RHO_HIGH
        rho = min(max(rho, RHO_LOW), RHO_HIGH)
        return 1 / rho - 1

    s_suffix, s_domain, s_host = strength(suffixes, "sn", "sx"), strength(domains, "dn", "dx"), strength(hosts, "n", "x")
    m_suffix = (F.col("sx") + s_suffix * p) / (F.col("sn") + s_suffix)
    means = suffixes.select("suffix", m_suffix.alias("m_suffix"), F.explode(F.sequence(F.lit(0), F.lit(SUFFIX_PARTS - 1))).alias("part"))
    parted = domains.withColumn("part", F.pmod(F.hash("domain"), F.lit(SUFFIX_PARTS))).join(means, ["suffix", "part"])
    m_domain = (F.col("dx") + s_domain * F.col("m_suffix")) / (F.col("dn") + s_domain)
    rated = hosts.select("host", "domain", "n", "x").join(parted.select("domain", m_domain.alias("m")), "domain")
    rated = rated.withColumns({"a": F.col("x") + s_host * F.col("m"), "b": F.col("n") - F.col("x") + s_host * (1 - F.col("m"))})
    mean = F.col("a") / (F.col("a") + F.col("b"))
    var = F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1))
    return rated.select("host", F.col("n").cast("long").alias("n"), F.col("x").cast("long").alias("bad"), mean.alias("bad_rate"), (mean - z * F.sqrt(var)).alias("lower"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = BAD_RATE_LIMIT, more: tuple[str, ...] = MORE_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``labels`` (page_id, bad) holds the known outcomes; a page with several
    counts as bad if any of them is, and null ids or outcomes say nothing. A
    null url, or one without ``://``, has an empty host, which is rated like any
    other host. A rule decides where one fits, the longest first; else a page is
    blocked if the lower bound of its host's bad rate is above ``limit``. A
    domain has one label more than its public suffix, which is the last label,
    or two where those are a category and a country or one of ``more``; hosts
    that are IP addresses are domains by themselves. Urls of any length are read
    whole.
    Repeated rows come back as often as they came and an empty table gives an
    empty result; other columns of ``pages`` are not read.
    """
    known = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("_label_id")).agg(F.max("bad").alias("bad"))
    at = split_url(pages.select("page_id", "url"))
    outcomes = at.select("page_id", "host").join(known, F.col("page_id") == F.col("_label_id"), "left").select("host", "bad")
    poor = cut(host_reputation(outcomes, more=more).filter(F.col("lower") > limit).select(F.col("host").alias("_poor")))
    rule, verdict = rule_columns(rules)
    method = F.when(F.col("_poor").isNotNull(), "block").otherwise("allow")
    rated = at.join(poor, F.col("host") == F.col("_poor"), "left")
    return rated.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """The labels table as outcomes of the pages of the same ids: bad if of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return url_filter(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))


QUERY = ("op6_url_filter", op6_url_filter)

def _strength_sql(name: str, count: str, bad: str, level: str) -> str:
    """A CTE with the strength of a level's prior."""
    rho = f"CASE WHEN count(*) > 0 AND any_value(g.n) > count(*) THEN (sum({count} * ({bad} / {count} - g.p) * ({bad} / {count} - g.p)) / (any_value(g.p) * (1 - any_value(g.p))) - count(*)) / (any_value(g.n) - count(*)) ELSE {RHO_HIGH} END"
    return f"{name} AS (SELECT 1 / least(greatest({rho}, {RHO_LOW}), {RHO_HIGH}) - 1 AS s FROM {level}, g WHERE {count} > 0)"


ORACLE = f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h0 AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host
), h1 AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:[0-9]*)?$', '') AS bare, string_split(bare, '.') AS ls, regexp_full_match(bare, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\]') AS ip FROM h0
), h2 AS (
  SELECT *, array_to_string(ls[-2:], '.') IN (SELECT l || '.' || c FROM (SELECT unnest({list(CATEGORY_LABELS)}) AS l), (SELECT DISTINCT ls[-1] AS c FROM h1) WHERE regexp_full_match(c, '[a-z][a-z]')) AS two FROM h1
), h AS (
  SELECT host, n, x, CASE WHEN ip THEN bare WHEN two THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain,
    CASE WHEN ip THEN '{ADDRESSES}' WHEN two THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix FROM h2
), d AS (SELECT domain, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS sn, sum(x) AS sx FROM h GROUP BY suffix),
g AS (SELECT coalesce(sum(n), 0) AS n, (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM h),
{_strength_sql("ks", "sn", "sx", "s")},
{_strength_sql("kd", "dn", "dx", "d")},
{_strength_sql("kh", "h.n", "h.x", "h")},
m AS (
  SELECT h.host, h.n, h.x, kh.s AS k, (d.dx + kd.s * ((s.sx + ks.s * g.p) / (s.sn + ks.s))) / (d.dn + kd.s) AS m
  FROM h JOIN s USING (suffix) JOIN d USING (domain), g, ks, kd, kh
), ab AS (SELECT host, x + k * m AS a, n - x + k * (1 - m) AS b FROM m),
poor AS (
  SELECT host FROM ab WHERE a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {BAD_RATE_LIMIT}
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM poor) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
