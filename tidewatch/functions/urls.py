"""URLs: hosts, structure features and structure rules, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import number_in
from tidewatch.lexicons import KOREAN, URL_EVIDENCE, Profile

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
THRESHOLD = 0.20

W_IP, W_SHORTENER, W_TLD, W_PUNYCODE, W_AT = 0.30, 0.25, 0.20, 0.20, 0.25
#: Least ratio or number, and weight, the strongest first.
W_DIGITS = ((0.20, 0.15), (0.10, 0.08))
W_SUBDOMAINS = ((3, 0.15), (2, 0.08))

FEATURES = (
    "url_length", "host_length", "host_digit_count", "host_digit_ratio", "host_letter_ratio", "host_hyphen_count", "max_domain_label_length",
    "path_length", "query_length", "fragment_length", "dot_count", "hyphen_count", "underscore_count", "slash_count", "question_count",
    "equal_count", "ampersand_count", "at_count", "percent_count", "digit_count", "digit_ratio", "letter_ratio", "special_ratio",
    "domain_part_count", "subdomain_count", "query_param_count", "has_https", "has_ip_address", "has_port", "has_punycode", "is_shortener",
    "is_suspicious_tld", "suspicious_word_count", "host_entropy", "url_entropy",
)


def with_scheme(url: Column) -> Column:
    """Lower case, trimmed, with http:// where no scheme is given; "" for blank and null."""
    value = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.when(value == "", "").when(value.rlike(SCHEME), value).otherwise(F.concat(F.lit("http://"), value))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """The lower-case host without user, port, a leading www. and outer dots; "" where there is none."""
    plain = F.regexp_replace(authority(with_scheme(url)), r"^.*@", "")
    host = F.when(plain.startswith("["), F.regexp_extract(plain, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(plain, r"^([^:]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^\.+|\.+$", "")


def resolved(base: Column, href: Column) -> Column:
    """A link's address seen from a page: absolute, from the scheme, from the host, or relative, without dot segments.

    A link that is only a query or a fragment keeps the page's path; the page's own fragment never
    stays. A scheme that has no host (mailto:, javascript:) is given back as it is.
    """
    link, page = F.trim(F.coalesce(href, F.lit(""))), F.coalesce(base, F.lit(""))
    part = lambda of, i: F.regexp_extract(of, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    scheme, host, path, query, fragment = (part(link, i) for i in range(1, 6))
    folder = F.when(part(page, 3) == "", "/").otherwise(F.regexp_replace(part(page, 3), "[^/]*$", ""))
    joined = F.when(host != "", path).when(path.startswith("/"), path).when(path != "", F.concat(folder, path)).otherwise(part(page, 3))
    # Each segment is pushed, dropped or takes the one before it away; the first is empty, for the leading slash.
    steps = F.split(joined, "/")
    def step(kept: Column, s: Column) -> Column:
        return F.when(s == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    walked = F.aggregate(steps, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise("")
    plain = F.concat(F.array_join(walked, "/"), ends)
    own_query = F.when((path == "") & (host == "") & (query == ""), part(page, 4)).otherwise(query)
    made = F.concat(part(page, 1), F.lit(":"), F.when(host != "", host).otherwise(part(page, 2)), plain, own_query, fragment)
    return F.when(scheme != "", link).when(link == "", F.regexp_replace(page, "#.*$", "")).otherwise(made)


#: Public suffixes of two labels, under which a registered domain has three.
SUFFIXES = (
    "ac.kr", "co.kr", "go.kr", "hs.kr", "kg.kr", "mil.kr", "ms.kr", "ne.kr", "or.kr", "pe.kr", "re.kr", "sc.kr", "es.kr", "seoul.kr", "busan.kr",
    "co.uk", "ac.uk", "gov.uk", "org.uk", "co.jp", "ac.jp", "go.jp", "ne.jp", "or.jp", "com.au", "net.au", "com.br", "com.cn", "com.hk", "com.tw", "co.nz", "co.in", "com.sg",
)


def registered_domain(host: Column) -> Column:
    """The label before a host's public suffix, with the suffix; the last two labels where no suffix of SUFFIXES ends it."""
    return registered_domain_under(host, SUFFIXES)


def registered_domain_under(host: Column, suffixes: tuple[str, ...]) -> Column:
    """The same for other suffixes, of any number of labels; the longest counts. A host that is a suffix is its own domain."""
    lower = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    known = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-s.count("."), s)))
    under = F.regexp_extract(lower, rf"(?:^|\.)([^.]+\.(?:{known}))$", 1) if suffixes else F.lit("")
    whole = lower.rlike(rf"^(?:{known})$") if suffixes else F.lit(False)
    return F.when(whole, lower).when(under != "", under).otherwise(F.substring_index(lower, ".", -2))


def tld_of(host: Column) -> Column:
    """The last label, "" without a dot."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")


def _hostname(url: Column) -> Column:
    """The host of an address with a scheme, without user and port, as it is written."""
    plain = F.regexp_replace(authority(url), r"^.*@", "")
    return F.when(plain.startswith("["), F.regexp_extract(plain, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(plain, r"^([^:]*)", 1))


def url_parts(url: Column) -> Column:
    """scheme, host, path, query and tld of an address as error analyses cut it: http:// is added only where "://" is nowhere in it.

    The host keeps outer dots but not a leading "www."; its last label is the tld, even if it is the only one.
    """
    value = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    full = F.when(value == "", "").when(F.instr(value, "://") > 0, value).otherwise(F.concat(F.lit("http://"), value))
    host = F.regexp_replace(_hostname(full), r"^www\.", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    part = lambda i: F.regexp_extract(full, r"^(?:([a-z][a-z0-9+.-]*):)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?", i)
    return F.struct(part(1).alias("scheme"), host.alias("host"), part(2).alias("path"), part(3).alias("query"), F.coalesce(F.get(labels, F.size(labels) - 1), F.lit("")).alias("tld"))


def page_tld(url: Column) -> Column:
    """The last label of an address's host, as counts by ending take it: "" where the host has fewer than two labels."""
    labels = F.filter(F.split(url_parts(url)["host"], r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 1)).otherwise("")


def dataset_url(url: Column) -> Column:
    """An address as datasets hold it: lower case without any blank, with http:// unless it begins with http:// or https://."""
    value = F.replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(value == "", "").when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("http://"), value))


def dataset_domain(url: Column) -> Column:
    """The host of dataset_url without a leading "www." and outer dots."""
    return F.regexp_replace(F.regexp_replace(_hostname(dataset_url(url)), r"^www\.", ""), r"^\.+|\.+$", "")


def is_ip(host: Column) -> Column:
    quad = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return quad & F.coalesce(F.forall(F.split(host, r"\."), lambda p: p.try_cast("int") <= 255), F.lit(False))  # a filter's parts run in any order


def is_valid_domain(domain: Column) -> Column:
    """A dot, at most 253 of [a-z0-9.-], and labels of 1 to 63 without a hyphen at an edge."""
    label = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    return F.coalesce((F.length(domain) <= 253) & domain.rlike(rf"^{label}(\.{label})+$"), F.lit(False))


def in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or under one."""
    pattern = "|".join(d.replace(".", r"\.") for d in domains)
    return F.coalesce(host.rlike(rf"(^|\.)({pattern})$"), F.lit(False)) if domains else F.lit(False)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for ""."""
    chars = F.array_sort(F.split(text, ""))
    # Sorted characters, so equal ones are runs; a run's length is added when it ends.
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))

    def part(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)

    def add(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"), F.when(same, acc["s"]).otherwise(acc["s"] + part(acc["n"])).alias("s"))

    total = F.length(text).cast("double")
    summed = F.aggregate(chars, start, add, lambda acc: acc["s"] + part(acc["n"]))
    return F.when(total > 0, F.log2(total) - summed / total).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def url_features(df: DataFrame, url: str = "url", profile: Profile = KOREAN) -> DataFrame:
    """Append the 35 structure features, all doubles. A blank or null URL has zeros throughout."""
    u, h = F.col("_u"), F.col("_h")
    rows = df.withColumn("_u", with_scheme(F.col(url)))
    rows = rows.withColumns(
        {
            "_h": host_of(F.col("_u")),
            "_path": F.regexp_extract(u, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1),
            "_query": F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1),
            "_fragment": F.regexp_extract(u, r"#(.*)$", 1),
            "_port": F.regexp_extract(F.regexp_replace(authority(F.col("_u")), r"^.*@", ""), r":([0-9]+)$", 1),
        }
    )
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    parts = F.when(h == "", 0).otherwise(F.size(labels))
    n, nh = F.length(u), F.length(h)
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    digits, letters = _count(u, r"\p{Nd}"), _count(u, r"\p{L}")
    pairs = F.filter(F.split(F.col("_query"), "&"), lambda x: x != "")
    names = F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    values = {
        "url_length": n, "host_length": nh, "host_digit_count": _count(h, r"\p{Nd}"), "host_digit_ratio": per(_count(h, r"\p{Nd}"), nh),
        "host_letter_ratio": per(_count(h, r"\p{L}"), nh), "host_hyphen_count": _count(h, "-"),
        "max_domain_label_length": F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)),
        "path_length": F.length("_path"), "query_length": F.length("_query"), "fragment_length": F.length("_fragment"),
        "dot_count": _count(u, r"\."), "hyphen_count": _count(u, "-"), "underscore_count": _count(u, "_"), "slash_count": _count(u, "/"),
        "question_count": _count(u, r"\?"), "equal_count": _count(u, "="), "ampersand_count": _count(u, "&"), "at_count": _count(u, "@"),
        "percent_count": _count(u, "%"), "digit_count": digits, "digit_ratio": per(digits, n), "letter_ratio": per(letters, n),
        "special_ratio": per(n - digits - letters, n), "domain_part_count": parts, "subdomain_count": F.greatest(parts - 2, F.lit(0)),
        "query_param_count": F.when(F.col("_query") == "", 0).otherwise(F.size(names)), "has_https": u.startswith("https://").cast("int"), "has_ip_address": is_ip(h).cast("int"),
        "has_port": ((F.col("_port") != "") & (F.length("_port") <= 5) & F.coalesce(F.col("_port").try_cast("int") <= 65535, F.lit(False))).cast("int"),
        "has_punycode": h.contains("xn--").cast("int"), "is_shortener": in_domains(h, profile.url_shorteners).cast("int"),
        "is_suspicious_tld": tld_of(h).isin(*profile.url_tlds).cast("int"), "suspicious_word_count": number_in(u, profile.url_words),
        "host_entropy": entropy(h), "url_entropy": entropy(u),
    }
    out = rows.withColumns({k: F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES})
    return out.drop("_u", "_h", "_path", "_query", "_fragment", "_port")


def _evidence(kind: str, detail: Column | str, weight: float) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(kind).alias("type"), detail.alias("detail"), F.lit(weight).alias("weight"))


def _told(kind: str, value: Column) -> tuple[str, Column]:
    name, detail = URL_EVIDENCE[kind]
    before, after = detail.split("{}")
    return name, F.concat(F.lit(before), value, F.lit(after))


def url_evidence(subdomains_of_ips: bool = False) -> Column:
    """Evidence of the structure rules over feature columns, as an array of (type, detail, weight)."""
    c = F.col
    percent = F.format_number(c("host_digit_ratio") * 100, 1)
    sub = c("subdomain_count").cast("int").cast("string")
    named = F.lit(True) if subdomains_of_ips else c("has_ip_address") < 1
    (high, w_high), (medium, w_medium) = W_DIGITS
    (many, w_many), (several, w_several) = W_SUBDOMAINS
    found = F.array(
        F.when(c("has_ip_address") >= 1, _evidence(*URL_EVIDENCE["ip"], W_IP)),
        F.when(c("is_shortener") >= 1, _evidence(*URL_EVIDENCE["shortener"], W_SHORTENER)),
        F.when(c("is_suspicious_tld") >= 1, _evidence(*URL_EVIDENCE["tld"], W_TLD)),
        F.when(c("has_punycode") >= 1, _evidence(*URL_EVIDENCE["punycode"], W_PUNYCODE)),
        F.when(c("at_count") >= 1, _evidence(*URL_EVIDENCE["at"], W_AT)),
        F.when(c("host_digit_ratio") >= high, _evidence(*_told("digits_high", percent), w_high)).when(
            c("host_digit_ratio") >= medium, _evidence(*_told("digits", percent), w_medium)
        ),
        F.when(named & (c("subdomain_count") >= many), _evidence(*_told("subdomains_many", sub), w_many)).when(
            named & (c("subdomain_count") >= several), _evidence(*_told("subdomains", sub), w_several)
        ),
    )
    return F.filter(found, lambda e: e.isNotNull())


def total_weight(evidence: Column) -> Column:
    """The sum of weights, at most 1, to four places."""
    return F.round(F.least(F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e["weight"]), F.lit(1.0)), 4)


def url_rules(df: DataFrame, url: str = "url", profile: Profile = KOREAN, threshold: float = THRESHOLD, subdomains_of_ips: bool = False) -> DataFrame:
    """Append rule_evidence, rule_score and is_suspicious of each URL's structure, with its features."""
    rows = url_features(df, url, profile).withColumn("rule_evidence", url_evidence(subdomains_of_ips))
    rows = rows.withColumn("rule_score", total_weight(F.col("rule_evidence")))
    return rows.withColumn("is_suspicious", F.col("rule_score") >= threshold)


def url_rules_of_messages(messages: DataFrame, key: str = "id", urls: str = "urls", profile: Profile = KOREAN) -> DataFrame:
    """(key, url_score, url_evidence): the rules over each message's distinct URLs; scores add up to at most 1."""
    each = messages.select(key, F.posexplode(F.array_distinct(F.transform(urls, F.trim))).alias("_at", "_url")).where("_url <> ''")
    rows = url_rules(each, "_url", profile)
    named = F.transform("rule_evidence", lambda e: F.struct(e["type"].alias("type"), F.concat(e["detail"], F.lit(" ("), F.col("_url"), F.lit(")")).alias("detail"), e["weight"].alias("weight")))
    grouped = rows.groupBy(key).agg(F.sum("rule_score").alias("s"), F.sort_array(F.collect_list(F.struct("_at", named.alias("e")))).alias("e"))
    return grouped.select(key, F.round(F.least("s", F.lit(1.0)), 4).alias("url_score"), F.flatten(F.transform("e", lambda x: x["e"])).alias("url_evidence"))
