"""Operator 3: URL filters by rules, and by empirical-Bayes host reputation where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the default rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Strengths of a prior are kept between these numbers of pseudo-outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule, written host + path, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _name(host: Column) -> Column:
    """A host without user information and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


#: Second labels under which registries of two-letter suffixes register names.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
_ADDRESS, _COMPOUND = r"^[0-9.]+$", rf"(^|\.)({SECOND_LEVEL})\.[a-z][a-z]$"


def suffix(host: Column) -> Column:
    """The last label of a host, or the last two (``co.uk``); an address is one name."""
    name = _name(host)
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_COMPOUND), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column) -> Column:
    """A host's suffix and the label before it, if there is one; an address as it is."""
    name = _name(host)
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_COMPOUND), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def _strength(groups: DataFrame, parent: str) -> Column:
    """Prior strength by moments: how little the groups' rates differ from their parents' rates beyond binomial noise."""
    m = F.col(parent)
    noise = m * (1 - m)
    g = groups.agg(
        F.sum(noise).alias("v"),
        F.sum(F.col("n") * noise).alias("nv"),
        F.sum(F.col("n") * (F.col("x") / F.col("n") - m) * (F.col("x") / F.col("n") - m)).alias("s"),
    )
    between = (F.col("s") - F.col("v")) / F.col("nv")
    return g.select(F.when((F.coalesce(F.col("nv"), F.lit(0.0)) <= 0) | (between <= 0), F.lit(STRONGEST)).otherwise(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), (1 - between) / between))).alias("strength"))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, lower): the posterior of each host's bad rate, from labelled outcomes (host, bad 0/1).

    Counts are summed up from host to registered domain to suffix; each level's rate is shrunk to the
    posterior mean of the level above by a beta prior whose strength is estimated by moments.  lower
    is mean - z standard deviations of the beta posterior, at least 0: the normal stand-in for its quantile.  Null hosts and null outcomes
    are ignored; a table without outcomes gives no rows.
    """
    host = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("x"))
    host = host.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    total = host.agg((F.sum("x") / F.sum("n")).alias("m0"))
    by_suffix = host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).crossJoin(F.broadcast(total))
    strength = _strength(by_suffix, "m0")
    by_suffix = by_suffix.crossJoin(F.broadcast(strength)).select("suffix", ((F.col("x") + F.col("strength") * F.col("m0")) / (F.col("n") + F.col("strength"))).alias("m1"))
    by_domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(by_suffix, "suffix")
    strength = _strength(by_domain, "m1")
    by_domain = by_domain.crossJoin(F.broadcast(strength)).select("domain", "suffix", ((F.col("x") + F.col("strength") * F.col("m1")) / (F.col("n") + F.col("strength"))).alias("m2"))
    by_host = host.join(by_domain, ["domain", "suffix"])
    strength = _strength(by_host, "m2")
    a, b = F.col("x") + F.col("strength") * F.col("m2"), F.col("n") - F.col("x") + F.col("strength") * (1 - F.col("m2"))
    mean = a / (a + b)
    lower = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))
    return by_host.crossJoin(F.broadcast(strength)).select("host", F.col("n").cast("long").alias("n"), F.col("x").cast("long").alias("bad"), mean.alias("mean"), lower.alias("lower"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, worst: float = 0.5, z: float = 1.645) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, from pages (page_id, url) and outcomes (host, bad).

    The longest fitting rule decides.  Where none fits, a page is blocked if its host's bad rate
    exceeds ``worst`` with the posterior bound, else allowed; a host without outcomes is allowed.
    Null urls and urls without ``://`` have empty host and path and are allowed.  Repeated rows come
    back as often; other columns are ignored; an empty table gives no rows.

    The join keys on the host, one row for each on the reputation's side, and only hosts that are to be
    blocked are on it; a host with a large part of all pages is split by the adaptive skew join.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    bad = host_reputation(outcomes, z).where(F.col("lower") > worst).select(F.col("host").alias("bad_host"))
    return parts.join(bad, F.col("host") == F.col("bad_host"), "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad_host").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose document is labelled: bad if of low quality or toxic.

    A page's document is the number that ends its path's second segment (``/en/825``).
    """
    host, path = url_parts(F.col("url"))
    doc = F.expr("try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') as bigint)")
    of = pages.select(host.alias("host"), path.alias("path")).select("host", doc.alias("doc_id")).where("doc_id is not null")
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return of.join(known, "doc_id").select("host", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter(pages, page_outcomes(pages, labels))


def _strength_sql(name: str, table: str, parent: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN coalesce(nv, 0) <= 0 OR (s - v) / nv <= 0 THEN {STRONGEST}
  ELSE least({STRONGEST}, greatest({WEAKEST}, (1 - (s - v) / nv) / ((s - v) / nv))) END AS k
  FROM (SELECT sum({parent} * (1 - {parent})) AS v, sum(n * {parent} * (1 - {parent})) AS nv, sum(n * (x / n - {parent}) * (x / n - {parent})) AS s FROM {table}))"""


_FITS = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'r': '{h + p}', 'v': '{v}'}} END" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
_AFTER = "regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's')"
OP3_SQL = f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {_AFTER} AS rest FROM pages)),
known AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
seen AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') AS BIGINT) AS doc_id FROM parts) JOIN known USING (doc_id)),
hosts AS (SELECT host, n, x, CASE WHEN address THEN name ELSE array_to_string(l[greatest(1, len(l) - k):], '.') END AS domain,
  CASE WHEN address THEN name ELSE array_to_string(l[greatest(1, len(l) - k + 1):], '.') END AS suffix FROM
  (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '{_ADDRESS}') AS address, CASE WHEN regexp_matches(name, '{_COMPOUND}') THEN 2 ELSE 1 END AS k FROM
  (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS x, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM seen GROUP BY host))),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT sum(x) / sum(n) FROM hosts) AS m FROM hosts GROUP BY 1),
{_strength_sql("k0", "s0", "m")},
s1 AS (SELECT suffix, (x + k * m) / (n + k) AS m FROM s0, k0),
d0 AS (SELECT * FROM (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1, 2) JOIN s1 USING (suffix)),
{_strength_sql("k1", "d0", "m")},
d1 AS (SELECT domain, suffix, (x + k * m) / (n + k) AS m FROM d0, k1),
h0 AS (SELECT host, n, x, m FROM hosts JOIN d1 USING (domain, suffix)),
{_strength_sql("k2", "h0", "m")},
h1 AS (SELECT host, (x + k * m) / (n + k) AS p, n + k AS t FROM h0, k2),
bad AS (SELECT host AS bad_host FROM h1 WHERE greatest(0, p - 1.645 * sqrt(p * (1 - p) / (t + 1))) > 0.5),
ruled AS (SELECT *, coalesce({", ".join(_FITS)}) AS fit FROM parts)
SELECT page_id, host, path, fit.r AS rule, coalesce(fit.v, CASE WHEN bad_host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN bad ON host = bad_host
"""
