"""URL filtering by empirical-Bayes host reputation, after explicit rules.

Pages with a known outcome are counted by host. A beta-binomial prior shrinks each host to its registered
domain (the last two labels), the domain to its suffix (the last label) and the suffix to the whole; how
strongly is estimated at each level from how much its groups differ. A host is blocked if the lower bound of
its posterior rate of bad pages is over ``block_above``: few outcomes never suffice against a good domain.
A host without outcomes has the posterior of none: the rate of its domain, else its suffix, else the whole.

Rules (host, path) come first: a rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins. They are a short list given by the caller and become one expression.

Null urls and urls without ``://`` have an empty host and path: no rule fits, and the empty host is judged like
any other. Outcomes that are null, or of no page, count nowhere; a page with several counts as bad if one is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of op9: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A normal quantile: the bound is passed by chance once in twenty times.
Z = 1.645
BLOCK_ABOVE = 0.5
#: Least and most prior strength, in pages.
STRENGTH = (1.0, 10000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """The prior's strength at a level, 1 / rho - 1, rho the intra-class correlation of its groups.

    ``groups`` has n and bad; the sums are of integers and of squares over n, made before the shuffle.
    """
    n, bad = F.sum("n"), F.sum("bad")
    sums = groups.agg(F.count("*").cast("double").alias("k"), n.cast("double").alias("n"), bad.cast("double").alias("bad"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.round(F.col("bad") * F.col("bad") / F.col("n"), 9).cast("decimal(30,9)")).cast("double").alias("bb"))
    between = F.expr("try_divide(bb - bad * bad / nullif(n, 0), k - 1)")
    within = F.expr("try_divide(bad - bb, n - k)")
    n0 = F.expr("try_divide(n - nn / nullif(n, 0), k - 1)")
    rho = F.try_divide(between - within, between + (n0 - 1) * within)
    usable = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("bad") > 0) & (F.col("bad") < F.col("n"))
    least, most = STRENGTH
    kappa = F.when(rho > 1 / (most + 1), F.greatest(F.lit(least), F.try_divide(F.lit(1.0), rho) - 1)).otherwise(F.lit(most))
    return sums.select(F.when(usable, kappa).otherwise(F.lit(most))).first()[0]


def host_reputation(outcomes: DataFrame, hosts_asked: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, rate, bound) of every host of ``outcomes`` (host, bad 0/1): the posterior mean and lower bound.

    Hosts of ``hosts_asked`` (host, distinct) without outcomes have n = 0; without any outcomes there are no rows.
    """
    hosts = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    levels = F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix")
    hosts = staged(hosts.select("*", *levels), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Five numbers, whatever the input.
    all_bad, all_n = suffixes.agg(F.sum("bad").cast("double"), F.sum("n").cast("double")).first()
    k_suffix, k_domain, k_host = (F.lit(_strength(groups)) for groups in (suffixes, domains, hosts))
    whole = F.lit(all_bad / all_n if all_n else 0.0)
    s = suffixes.select(F.col("suffix").alias("s"), ((F.col("bad") + k_suffix * whole) / (F.col("n") + k_suffix)).alias("s_rate"))
    d = domains.join(s, F.col("suffix") == F.col("s")).select(F.col("domain").alias("d"), ((F.col("bad") + k_domain * F.col("s_rate")) / (F.col("n") + k_domain)).alias("d_rate"))
    h = hosts.join(d, F.col("domain") == F.col("d")).select("host", "n", "bad", "d_rate")
    if hosts_asked is not None and all_n:
        new = hosts_asked.join(hosts.select("host"), "host", "left_anti").select("host", *levels)
        # A domain without outcomes has its suffix's rate, a suffix without outcomes the whole's.
        new = new.join(d, F.col("domain") == F.col("d"), "left").join(s, F.col("suffix") == F.col("s"), "left")
        h = h.unionByName(new.select("host", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"), F.coalesce("d_rate", "s_rate", whole).alias("d_rate")))
    h = h.withColumn("rate", (F.col("bad") + k_host * F.col("d_rate")) / (F.col("n") + k_host))
    h = h.withColumn("bound", F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k_host + 1)))
    return h.select("host", "n", "bad", "rate", "bound")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", block_above: float = BLOCK_ABOVE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of each row of ``pages``; ``outcomes`` has page_id and bad (0/1).

    Only urls are read. Without any outcomes all hosts are allowed: nothing is known against them.
    """
    host, path = split_url(pages[url])
    parsed = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("o_id")).agg(F.max("bad").alias("bad"))
    seen = parsed.join(known, F.col("page_id") == F.col("o_id")).select("host", "bad")
    # A staged table, so that a join with it splits a host that has a third of all pages.
    bounds = staged(host_reputation(seen, parsed.select("host").distinct()).select(F.col("host").alias("h"), "bound"), "bounds")
    judged = parsed.join(bounds, F.col("host") == F.col("h"), "left").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > block_above, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), "bound")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page's outcome is bad if the labels of its id say low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.greatest(1 - F.col("quality").cast("int"), F.col("toxic").cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes).drop("bound")


def _rules_sql() -> str:
    cases = []
    for verdict, host, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{'rule': '{host + path}', 'verdict': '{verdict}'}}")
    return "CASE " + " ".join(cases) + " END"


def _strength_sql(table: str) -> str:
    return f"""(SELECT CASE WHEN k > 1 AND n > k AND bad > 0 AND bad < n AND rho > 1 / ({STRENGTH[1]} + 1) THEN greatest({STRENGTH[0]}::DOUBLE, 1 / rho - 1) ELSE {STRENGTH[1]}::DOUBLE END FROM (
      SELECT *, (b - w) / (b + (n0 - 1) * w) AS rho FROM (
        SELECT *, (bb - bad * bad / n) / (k - 1) AS b, (bad - bb) / (n - k) AS w, (n - nn / n) / (k - 1) AS n0 FROM (
          SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn, sum(round(bad::DOUBLE * bad / n, 9)::DECIMAL(30, 9))::DOUBLE AS bb FROM {table}))))"""


OP9_SQL = rf"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
known AS (
  SELECT doc_id AS o_id, max(greatest(1 - quality, toxic)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND greatest(1 - quality, toxic) IS NOT NULL GROUP BY doc_id),
levelled AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
         array_to_string(list_slice(string_split(host, '.'), -1, -1), '.') AS suffix FROM parsed),
hosts AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS bad, domain, suffix FROM levelled JOIN known ON page_id = o_id GROUP BY host, domain, suffix),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
strengths AS (
  SELECT {_strength_sql('suffixes')} AS k_suffix, {_strength_sql('domains')} AS k_domain, {_strength_sql('hosts')} AS k_host,
         (SELECT sum(bad)::DOUBLE FROM suffixes) AS all_bad, (SELECT sum(n)::DOUBLE FROM suffixes) AS all_n),
s AS (SELECT suffix, (bad + k_suffix * all_bad / all_n) / (n + k_suffix) AS s_rate FROM suffixes, strengths),
d AS (SELECT domain, (bad + k_domain * s_rate) / (n + k_domain) AS d_rate FROM domains JOIN s USING (suffix), strengths),
h AS (
  SELECT a.host, coalesce(x.n, 0) + k_host AS m, (coalesce(x.bad, 0) + k_host * coalesce(d_rate, s_rate, all_bad / all_n)) / (coalesce(x.n, 0) + k_host) AS rate
  FROM (SELECT DISTINCT host, domain, suffix FROM levelled) a LEFT JOIN hosts x ON a.host = x.host LEFT JOIN d ON a.domain = d.domain LEFT JOIN s ON a.suffix = s.suffix, strengths WHERE all_n > 0),
bounds AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (m + 1)) AS bound FROM h),
judged AS (SELECT page_id, parsed.host, path, bound, {_rules_sql().replace("(host =", "(parsed.host =").replace("ends_with(host", "ends_with(parsed.host")} AS r FROM (SELECT * FROM parsed) parsed LEFT JOIN bounds ON parsed.host = bounds.host)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
