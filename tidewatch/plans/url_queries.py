"""Queries over URLs and hosts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import urls as U
from tidewatch.lexicons import ENGLISH
from tidewatch.operators import relational as R
from tidewatch.plans.tables import page_reports, table, urls

#: On pages the structure rules give 0 or 0.08, so rows are flagged at the lowest threshold of their sweep.
FLAG = 0.08
BINARY = ("has_https", "has_ip_address", "is_suspicious_tld")

HOSTS = r"""
u0 AS (SELECT url, lower(trim(coalesce(url, ''))) AS v FROM urls),
u1 AS (SELECT url, CASE WHEN v = '' THEN '' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*://') THEN v ELSE 'http://' || v END AS u FROM u0),
u2 AS (SELECT url, u, regexp_replace(regexp_extract(u, '^[^:/?#]*://([^/?#]*)', 1), '^.*@', '') AS a FROM u1),
h AS (SELECT url, u, regexp_extract(a, ':([0-9]+)$', 1) AS port, regexp_replace(regexp_replace(regexp_extract(a, '^([^:]*)', 1), '^www\.', ''), '^\.+|\.+$', '', 'g') AS h FROM u2)
"""
URLS = r"""urls AS (
  SELECT url FROM pages UNION
  SELECT DISTINCT 'http://' || ip || '/login' FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip FROM documents)
)"""
PAGES = "urls AS (SELECT url FROM pages)"

_ENTROPY = "CASE WHEN {x} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -(len(list_filter(string_split({x}, ''), lambda d: d = c)) / length({x})) * log2(len(list_filter(string_split({x}, ''), lambda d: d = c)) / length({x})))) END"


def _n(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


def _ratio(a: str, x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {a} / length({x}) ELSE 0 END"


_LABELS = "list_filter(string_split(h, '.'), lambda x: x <> '')"
_DIGITS, _LETTERS = _n("u", r"\p{Nd}"), _n("u", r"\p{L}")
_PATH, _QUERY, _FRAGMENT = r"regexp_extract(u, '^[^:/?#]*://[^/?#]*([^?#]*)', 1)", r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)", r"regexp_extract(u, '#(.*)$', 1)"
_IP = r"(regexp_matches(h, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AND len(list_filter(string_split(h, '.'), lambda x: TRY_CAST(x AS INT) > 255)) = 0)"
_SQL = {
    "url_length": "length(u)", "host_length": "length(h)", "host_digit_count": _n("h", r"\p{Nd}"), "host_digit_ratio": _ratio(_n("h", r"\p{Nd}"), "h"),
    "host_letter_ratio": _ratio(_n("h", r"\p{L}"), "h"), "host_hyphen_count": _n("h", "-"), "max_domain_label_length": f"coalesce(list_max(list_transform({_LABELS}, lambda x: length(x))), 0)",
    "path_length": f"length({_PATH})", "query_length": f"length({_QUERY})", "fragment_length": f"length({_FRAGMENT})", "dot_count": _n("u", r"\."), "hyphen_count": _n("u", "-"),
    "underscore_count": _n("u", "_"), "slash_count": _n("u", "/"), "question_count": _n("u", r"\?"), "equal_count": _n("u", "="), "ampersand_count": _n("u", "&"), "at_count": _n("u", "@"),
    "percent_count": _n("u", "%"), "digit_count": _DIGITS, "digit_ratio": _ratio(_DIGITS, "u"), "letter_ratio": _ratio(_LETTERS, "u"), "special_ratio": _ratio(f"(length(u) - {_DIGITS} - {_LETTERS})", "u"),
    "domain_part_count": f"len({_LABELS})", "subdomain_count": f"greatest(len({_LABELS}) - 2, 0)",
    "query_param_count": f"len(list_distinct(list_transform(list_filter(string_split({_QUERY}, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1))))",
    "has_https": "CASE WHEN starts_with(u, 'https://') THEN 1 ELSE 0 END", "has_ip_address": f"CASE WHEN {_IP} THEN 1 ELSE 0 END",
    "has_port": "CASE WHEN port <> '' AND length(port) <= 5 AND TRY_CAST(port AS INT) <= 65535 THEN 1 ELSE 0 END", "has_punycode": "CASE WHEN contains(h, 'xn--') THEN 1 ELSE 0 END",
    "is_shortener": "CASE WHEN regexp_matches(h, '(^|\\.)({})$') THEN 1 ELSE 0 END".format("|".join(d.replace(".", r"\.") for d in ENGLISH.url_shorteners)),
    "is_suspicious_tld": "CASE WHEN contains(h, '.') AND split_part(h, '.', -1) IN ({}) THEN 1 ELSE 0 END".format(", ".join(f"'{t}'" for t in ENGLISH.url_tlds)),
    "suspicious_word_count": " + ".join(f"CASE WHEN contains(u, '{w}') THEN 1 ELSE 0 END" for w in ENGLISH.url_words),
    "host_entropy": _ENTROPY.format(x="h"), "url_entropy": _ENTROPY.format(x="u"),
}
_FEATURES = ", ".join(f"round(CAST({_SQL[k]} AS DOUBLE), 6) AS {k}" for k in U.FEATURES)
_RULES = r""", f AS (SELECT url, h, """ + ", ".join(f"CAST({_SQL[k]} AS DOUBLE) AS {k}" for k in ("has_ip_address", "is_shortener", "is_suspicious_tld", "has_punycode", "at_count", "host_digit_ratio", "subdomain_count", "has_https")) + r""" FROM h),
r AS (
  SELECT *, round(least(1.0, CAST(0.30 * has_ip_address + 0.25 * is_shortener + 0.20 * is_suspicious_tld + 0.20 * has_punycode + 0.25 * (CASE WHEN at_count >= 1 THEN 1 ELSE 0 END)
    + CASE WHEN host_digit_ratio >= 0.20 THEN 0.15 WHEN host_digit_ratio >= 0.10 THEN 0.08 ELSE 0 END
    + CASE WHEN has_ip_address >= 1 THEN 0 WHEN subdomain_count >= 3 THEN 0.15 WHEN subdomain_count >= 2 THEN 0.08 ELSE 0 END AS DOUBLE)), 4) AS rule_score FROM f
)"""


def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.url_features(urls(spark, sf_dir), profile=ENGLISH)
    return rows.select("url", *[F.round(c, 6).alias(c) for c in U.FEATURES])


def url_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.url_rules(urls(spark, sf_dir), profile=ENGLISH)
    return rows.select("url", "rule_score", F.size("rule_evidence").cast("long").alias("n_evidence"), "is_suspicious")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.url_rules(urls(spark, sf_dir), profile=ENGLISH, threshold=FLAG)
    return rows.withColumn("flag", F.col("is_suspicious").cast("int")).withColumn("tld", U.tld_of(U.host_of(F.col("url"))))


def tld_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tld_statistics(_flagged(spark, sf_dir), "tld", "flag")


def host_feature_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of a URL by class."""
    return R.feature_quantiles(U.url_features(_flagged(spark, sf_dir).select("url", "flag"), profile=ENGLISH), list(U.FEATURES), "flag")


def binary_feature_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir).groupBy("flag")
    return rows.agg(F.count("*").alias("rows"), *[F.round(F.avg(c), 6).alias(c) for c in BINARY])


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.host_of(F.col("url"))
    rows = urls(spark, sf_dir).withColumn("host", host)
    return rows.select("url", "host", U.registered_domain(F.col("host")).alias("domain"), U.tld_of(F.col("host")).alias("tld"), U.is_ip(F.col("host")).alias("is_ip"), U.is_valid_domain(F.col("host")).alias("is_valid"))


def domain_trends_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_reports(spark, sf_dir).select(F.explode(F.array_distinct(F.transform("domains", U.registered_domain))).alias("label")).where("label <> ''")
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(5)


def reputation_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against all pages as reports, by host."""
    from tidewatch.operators.reports import reputation

    rows = page_reports(spark, sf_dir)
    found = reputation(rows.select("id", "domains", "tokens"), rows)
    return found.select(F.col("id").alias("page_id"), "rep_score", F.col("rep_evidence")[0]["detail"].alias("detail"))


def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose registered domain is that of a page with suspicious structure."""
    flagged = _flagged(spark, sf_dir).where("flag = 1 AND has_ip_address = 0").select(U.registered_domain(U.host_of(F.col("url"))).alias("domain")).distinct()
    pages = table(spark, sf_dir, "pages").select("page_id", U.registered_domain(U.host_of(F.col("url"))).alias("domain"))
    return pages.join(flagged, "domain", "left_semi").select("page_id", "domain")


QUERIES = {
    "url_features": url_features, "url_rule_score": url_rule_score, "tld_statistics": tld_statistics, "host_feature_quantiles": host_feature_quantiles, "binary_feature_rates": binary_feature_rates,
    "url_hosts": url_hosts, "domain_trends_topk": domain_trends_topk, "reputation_domains": reputation_domains, "blocked_pages": blocked_pages,
}

_FLAG = f"WITH {URLS}, {HOSTS} {_RULES}, g AS (SELECT *, CASE WHEN rule_score >= {FLAG} THEN 1 ELSE 0 END AS flag, CASE WHEN contains(h, '.') THEN split_part(h, '.', -1) ELSE '' END AS tld FROM r)"
_REG = "CASE WHEN len(string_split(h, '.')) >= 2 THEN split_part(h, '.', -2) || '.' || split_part(h, '.', -1) ELSE h END"
ORACLES = {
    "url_features": f"WITH {URLS}, {HOSTS} SELECT url, {_FEATURES} FROM h",
    "url_rule_score": f"""WITH {URLS}, {HOSTS} {_RULES} SELECT url, rule_score, CAST(has_ip_address + is_shortener + is_suspicious_tld + has_punycode + CASE WHEN at_count >= 1 THEN 1 ELSE 0 END
        + CASE WHEN host_digit_ratio >= 0.10 THEN 1 ELSE 0 END + CASE WHEN has_ip_address < 1 AND subdomain_count >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence, rule_score >= 0.20 AS is_suspicious FROM r""",
    "tld_statistics": f"""{_FLAG} SELECT tld, count(*) FILTER (flag = 0) AS normal, count(*) FILTER (flag = 1) AS phishing, round(count(*) FILTER (flag = 1) / count(*), 6) AS rate,
        count(*) FILTER (flag = 1) >= 20 AND round(count(*) FILTER (flag = 1) / count(*), 6) >= 0.90 AS candidate FROM g GROUP BY tld""",
    "host_feature_quantiles": f"""{_FLAG}, x AS (SELECT url, {", ".join(f"CAST({_SQL[k]} AS DOUBLE) AS {k}" for k in U.FEATURES)} FROM h), y AS (SELECT x.*, flag FROM x JOIN g ON x.url = g.url),
      l AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, flag, {k} AS v FROM y" for k in U.FEATURES)})
      SELECT feature, flag AS class, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90,
        round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM l GROUP BY feature, flag""",
    "binary_feature_rates": f"{_FLAG} SELECT flag, count(*) AS rows, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in BINARY) + " FROM g GROUP BY flag",
    "url_hosts": f"""WITH {URLS}, {HOSTS} SELECT url, h AS host, {_REG} AS domain, CASE WHEN contains(h, '.') THEN split_part(h, '.', -1) ELSE '' END AS tld, {_IP} AS is_ip,
        length(h) <= 253 AND regexp_matches(h, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+$') AS is_valid FROM h""",
    "domain_trends_topk": f"WITH {PAGES}, {HOSTS} SELECT {_REG} AS label, count(*) AS count FROM h WHERE h <> '' GROUP BY 1 ORDER BY count DESC, label LIMIT 5",
    "reputation_domains": f"""WITH {PAGES}, {HOSTS}, p AS (SELECT page_id, h.h FROM pages JOIN (SELECT DISTINCT url, h FROM h) h ON pages.url = h.url), n AS (SELECT h, count(*) AS n FROM p GROUP BY h)
      SELECT page_id, CAST(round(least(0.60, CAST(0.35 + 0.05 * (n - 1) AS DOUBLE)), 4) AS DOUBLE) AS rep_score, p.h || ' (신고 ' || n || '건)' AS detail FROM p JOIN n ON p.h = n.h""",
    "blocked_pages": f"""{_FLAG}, d AS (SELECT DISTINCT {_REG} AS domain FROM g WHERE flag = 1 AND has_ip_address = 0),
      q AS (SELECT page_id, {_REG.replace("h,", "i.h,").replace("ELSE h", "ELSE i.h")} AS domain FROM pages JOIN (SELECT DISTINCT url, h FROM h) i ON pages.url = i.url) SELECT page_id, domain FROM q WHERE domain IN (SELECT domain FROM d)""",
}
