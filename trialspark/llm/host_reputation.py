"""URL filter: prefix rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain
and public suffix.  Each level's bad rate is shrunk towards its parent's
posterior mean through a beta-binomial prior (suffix towards the overall
rate, domain towards its suffix, host towards its domain); the prior's
strength is estimated per level by the method of moments from the spread of
the children around their parents.  A host is blocked when the lower bound
of its posterior bad rate is over ``max_bad``, or by default over the bad rate
of all labelled pages: then it is worse than the average page, whatever is
labelled bad how often, and few labels never block.
Everything is DataFrame aggregation and joins; counts are pre-aggregated, so
a host that holds a third of all pages is a few rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import ascii_lower, without
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level labels under which domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
OUT = ("host", "path", "rule", "verdict", "labelled", "bad_rate", "bad_lower")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules`` is a short literal list."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """Last two labels of the host name (three under e.g. ``co.uk``); a numeric address or one label stands whole."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = "|".join(SECOND_LEVEL)
    found = F.regexp_extract(name, rf"([^.]+\.(?:(?:{two})\.[a-z][a-z]|[^.]+))$", 1)
    return F.when(name.rlike(r"^[\d.]+$") | (found == ""), name).otherwise(found)


def public_suffix(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[\d.]+$") | ~domain.contains("."), F.lit("")).otherwise(
        F.regexp_replace(domain, r"^[^.]*\.", ""))


def _shrunk(children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Add mean (posterior bad rate) and strength (the prior's) to ``children`` (key, parent, n, bad)."""
    joined = children.join(parents.select(F.col(parent), F.col("mean").alias("prior")), parent)
    spread = F.greatest(F.col("prior") * (1 - F.col("prior")), F.lit(1e-6))
    off = F.col("bad") - F.col("n") * F.col("prior")
    moments = joined.filter("n > 0").agg(
        F.sum(off * off / (F.col("n") * spread)).alias("chi"), F.count(F.lit(1)).alias("units"),
        F.sum(F.col("n") - 1).alias("extra"))
    rho = F.when(F.col("extra") > 0, (F.col("chi") - F.col("units")) / F.col("extra")).otherwise(F.lit(0.5))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(1e-3)), F.lit(0.99))
    strength = moments.select(((1 - rho) / rho).alias("strength"))
    return joined.crossJoin(F.broadcast(strength)).select(  # one row
        key, *[c for c in ("domain", "suffix") if c in children.columns and c != key], "n", "bad",
        ((F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))).alias("mean"),
        "strength")


def host_posteriors(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, labelled, bad_rate, bad_lower, overall) from (host, n, bad): one row per host, labelled or not.

    ``bad_lower`` is the posterior mean less ``z`` posterior standard deviations, not below zero;
    ``overall`` is the bad rate of all labelled pages.
    """
    counts = hosts.withColumn("domain", registered_domain(F.col("host"))) \
                  .withColumn("suffix", public_suffix(F.col("domain")))
    counts = materialize(counts, "host_counts")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5)
                            / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean"), F.lit(0).alias("all"))
    s = materialize(_shrunk(suffixes.withColumn("all", F.lit(0)), overall, "suffix", "all"), "suffix_rates")
    d = materialize(_shrunk(domains, s, "domain", "suffix"), "domain_rates")
    h = _shrunk(counts, d, "host", "domain")
    total = F.col("n") + F.col("strength")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    rates = h.select("host", F.col("n").alias("labelled"), F.col("mean").alias("bad_rate"),
                     F.greatest(F.col("mean") - z * deviation, F.lit(0.0)).alias("bad_lower"))
    return rates.crossJoin(F.broadcast(overall.select(F.col("mean").alias("overall"))))  # one row


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url",
               rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float | None = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, labelled, bad_rate, bad_lower.

    ``outcomes`` is (id, bad): several rows of one id count once, as bad if any
    is; rows with a null id or outcome don't count.  Without ``max_bad`` the
    bound is the bad rate of all labelled pages.  A repeated page counts as
    often as it occurs.  Null urls and urls without ``://`` have an empty host,
    which is judged like any other.  Input columns with the names of added
    ones are replaced.  Empty tables give no rows, or no reputation.
    """
    pages = without(pages, OUT)
    link = F.col(f"`{url}`")
    judged = outcomes.filter("id is not null and bad is not null").groupBy("id").agg(
        F.max(F.col("bad").cast("int")).alias("bad"))
    seen = pages.select(F.col(f"`{page_id}`").alias("id"), url_host(link).alias("host"))
    hosts = (seen.join(judged, "id", "left").groupBy("host")
             .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    scores = materialize(host_posteriors(hosts, z), "host_rates")
    out = pages.withColumns({"host": url_host(link), "path": url_path(link)})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = join_by_size(out, scores, "host", "left")
    own = F.when(F.col("bad_lower") > (F.col("overall") if max_bad is None else F.lit(max_bad)), "block").otherwise("allow")
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, own).alias("verdict"), "labelled", "bad_rate", "bad_lower")


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_lower; a page is bad if its id's label says toxic or poor."""
    bad = F.greatest((F.col("toxic") == 1).cast("int"), (F.col("quality") == 0).cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return judge_urls(pages.select("page_id", "url"), outcomes, max_bad=None).select(
        "page_id", "host", "path", "rule", "verdict", "bad_rate", "bad_lower")


def _level(name: str, children: str, parents: str, key: str, parent: str, keep: str) -> str:
    return f"""
{name}_j AS (SELECT c.*, p.mean AS prior FROM {children} c JOIN {parents} p USING ({parent})),
{name}_m AS (
  SELECT sum((bad - n * prior) ** 2 / (n * greatest(prior * (1 - prior), 1e-6))) AS chi, count(*) AS units, sum(n - 1) AS extra
  FROM {name}_j WHERE n > 0),
{name}_r AS (
  SELECT least(greatest(coalesce(CASE WHEN extra > 0 THEN (chi - units) / extra ELSE 0.5 END, 0.5), 1e-3), 0.99) AS rho FROM {name}_m),
{name} AS (
  SELECT {keep}, n, bad, (1 - rho) / rho AS strength, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean
  FROM {name}_j, {name}_r)"""


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
o AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
h0 AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM u LEFT JOIN o ON page_id = doc_id GROUP BY host),
h AS (
  SELECT host, n, bad, CASE WHEN regexp_matches(name, '^[\d.]+$') OR x = '' THEN name ELSE x END AS domain
  FROM (SELECT *, regexp_extract(name, '([^.]+\.(?:(?:SECOND)\.[a-z][a-z]|[^.]+))$', 1) AS x FROM h0)),
c AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[\d.]+$') OR NOT contains(domain, '.') THEN '' ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix
  FROM h),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY ALL),
suf AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY ALL),
top AS (SELECT 0 AS one, (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM suf),
""".replace("SECOND", "|".join(SECOND_LEVEL)) + ",".join([
    _level("s", "suf", "top", "suffix", "one", "suffix"), _level("d", "dom", "s", "domain", "suffix", "domain, suffix"),
    _level("hh", "c", "d", "host", "domain", "host")]) + """,
p AS (
  SELECT host, mean AS bad_rate, greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength + 1)), 0) AS bad_lower FROM hh),
r(what, rh, rp) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + """),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(what, length(rh || rp)) AS what
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, best.rule AS rule,
       coalesce(best.what, CASE WHEN bad_lower > (SELECT mean FROM top) THEN 'block' ELSE 'allow' END) AS verdict,
       bad_rate, bad_lower
FROM u LEFT JOIN best USING (page_id) LEFT JOIN p ON u.host = p.host
"""
