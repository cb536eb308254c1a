"""URL filtering by rules, and by an empirical-Bayes reputation of hosts.

A page's outcome is bad (1) or good (0). The bad share of a host is shrunk to that of its
registered domain, which is shrunk to that of its suffix, and that to the share of all pages: at each level the
parent's posterior mean is the mean of a beta prior, whose weight is estimated by moments from
how far the level's groups lie from their parents. A host is blocked if the lower bound of its posterior exceeds a limit.
The registered domain is the host's last two labels, the suffix the last.

Only DataFrame functions are used. Defined results: a null URL, or one without ``://``, has an empty
host and an empty path, and pages with an empty host are a host of their own; pages without an outcome are judged but
do not count. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import broadcast_if_small

#: verdict, host, path
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Standard deviations below the posterior mean, and the bad share that this bound must exceed.
DEVIATIONS, LIMIT = 2.0, 0.5
#: Bounds of the share of variation that lies between the groups of a level; a prior weighs 1 / share - 1 pages.
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct ``(length, rule, verdict)``; null if none does."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (bad, n, prior) with ``weight`` of the prior, ``mean`` and ``bound`` of the posterior."""
    noise = F.col("prior") * (1 - F.col("prior"))
    excess = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - noise)
    spread = F.coalesce(excess / F.nullif(F.sum((F.col("n") - 1) * noise), F.lit(0.0)), F.lit(MOST_SPREAD))
    spread = F.greatest(F.lit(LEAST_SPREAD), F.least(F.lit(MOST_SPREAD), spread))
    # One row on the right side.
    out = groups.join(F.broadcast(groups.where("n > 0").agg(spread.alias("spread"))))
    out = out.withColumn("weight", 1 / F.col("spread") - 1).drop("spread")
    out = out.withColumn("mean", (F.col("bad") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))
    return out.withColumn("bound", F.col("mean") - DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1)))


def reputations(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, mean, bound`` from ``host, bad`` (0, 1 or null), one row a host."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("prior"))
    suffixes = _shrunk(suffixes.join(F.broadcast(overall)))
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    return _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain")).select("host", "n", "bad", "mean", "bound")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", key: str = "page_id", limit: float = LIMIT, outcome: Column | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, bad_share, bound`` of every row.

    The outcome of a page, unless given as a column of ``pages``, is bad where a rule blocks it and good elsewhere.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"), *([] if outcome is None else [outcome.cast("int").alias("bad")]))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if outcome is None:
        rows = rows.withColumn("bad", F.coalesce((F.col("found.verdict") == "block").cast("int"), F.lit(0)))
    known = reputations(rows.select("host", "bad"))
    out = rows.join(broadcast_if_small(known), "host")
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("k").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.col("mean").alias("bad_share"), "bound")


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, arg_max(verdict, length(h || p)) AS verdict, arg_max(h || p, length(h || p)) AS rule
  FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), judged AS (
  SELECT u.page_id, host, path, rule, verdict, coalesce((verdict = 'block')::INT, 0) AS bad FROM urls u LEFT JOIN fits USING (page_id)
), hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
  FROM judged GROUP BY host
), overall AS (SELECT sum(bad) / sum(n) AS prior FROM hosts
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM hosts, overall GROUP BY suffix
), s1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5))) - 1 AS w FROM s0
), s2 AS (SELECT suffix, (bad + w * prior) / (n + w) AS mean FROM s0, s1
), d0 AS (SELECT h.domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS prior FROM hosts h JOIN s2 USING (suffix) GROUP BY h.domain
), d1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5))) - 1 AS w FROM d0
), d2 AS (SELECT domain, (bad + w * prior) / (n + w) AS mean FROM d0, d1
), h0 AS (SELECT host, n, bad, mean AS prior FROM hosts JOIN d2 USING (domain)
), h1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5))) - 1 AS w FROM h0
), h2 AS (SELECT host, n, w, (bad + w * prior) / (n + w) AS mean FROM h0, h1)
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN mean - 2.0 * sqrt(mean * (1 - mean) / (n + w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN h2 USING (host)
"""
