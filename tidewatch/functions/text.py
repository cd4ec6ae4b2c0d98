"""Message texts: normal form, URLs in text, tokens, the model's view, templates and categories.

Spark has no Unicode normal forms, so ``normalize`` passes texts to Python in Arrow batches; all
else is JVM-side expressions. Patterns use (?U) where word, digit and space mean those of Unicode.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import any_in, cascade, once, strings
from tidewatch.functions.urls import host_of, in_domains
from tidewatch.lexicons import FIND_URL, GENERATED_PHONE, GENERATED_URL, KOREAN, MASK_URL, MODEL_URL, PHONE, URL_PARTICLES, Profile

TOKEN = r"[0-9A-Za-z가-힣]+"
_URL_CHARS = r"A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\-"


def nfkc(text: Column) -> Column:
    """NFKC form, null as ""; texts in ASCII are their own form, and nothing is computed for them."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        odd = batch.notna()
        out = batch.fillna("")
        out[odd] = out[odd].str.normalize("NFKC")
        return out

    plain = F.coalesce(text, F.lit(""))
    ascii_ = F.octet_length(plain) == F.length(plain)
    return F.when(ascii_, plain).otherwise(run(F.when(~ascii_, plain)))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalize(text: Column) -> Column:
    """NFKC, without zero-width spaces, white space squeezed; null is ""."""
    return squeeze(F.translate(nfkc(text), "​﻿", ""))


def repaired_for_urls(text: Column) -> Column:
    """The text in which URLs are looked for: broken scheme URLs joined, in at most five passes, and bit/ly restored."""
    out = F.translate(nfkc(text), "​﻿", "")
    out = F.regexp_replace(out, r"(?Ui)\b(https?://)\s+", "$1")
    for _ in range(5):
        out = F.regexp_replace(out, rf"(?i)(https?://[{_URL_CHARS}]*)[\r\n\t ]+(?=[{_URL_CHARS}])", "$1")
    return F.regexp_replace(out, r"(?Ui)\bbit\s*/\s*ly\b", "bit.ly")


def found_urls(scan: Column) -> Column:
    """URLs of a text in order, each once, without closing punctuation and one trailing particle."""
    hits = F.regexp_extract_all(scan, F.lit(FIND_URL), F.lit(0))
    clean = F.transform(hits, lambda u: F.regexp_replace(F.regexp_replace(u, r"[.,);\]}>。，]+$", ""), URL_PARTICLES, ""))
    return F.array_distinct(F.filter(clean, lambda u: u != ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MASK_URL, "[URL]")


def preprocess(messages: DataFrame, text: str = "text", sender: str | None = "sender") -> DataFrame:
    """Append norm, masked, urls, domains, tokens and, from the sender column, a trimmed sender or null."""
    rows = messages.withColumn("norm", normalize(F.col(text))).withColumn("_scan", repaired_for_urls(F.col(text)))
    rows = rows.withColumn("urls", found_urls(F.col("_scan"))).withColumn("masked", mask_urls(F.col("norm")))
    domains = F.array_distinct(F.filter(F.transform("urls", host_of), lambda d: d != ""))
    rows = rows.withColumns({"domains": domains, "tokens": tokens(F.col("masked"))}).drop("_scan")
    who = F.trim(F.col(sender)) if sender and sender in messages.columns else F.lit(None).cast("string")
    return rows.withColumn("sender", F.when(who != "", who))


def case_key(sender: Column, domains: Column, urls: Column, norm: Column) -> Column:
    """SHA-256 of sender, sorted domains, sorted URLs and text, each with its length before it."""

    def framed(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        return F.concat(F.length(x).cast("string"), F.lit(":"), x)

    arrays = [F.array_join(F.transform(F.array_sort(a), framed), "") for a in (domains, urls)]
    present = F.when(sender.isNull(), "-").otherwise("+")
    return F.sha2(F.concat(present, framed(sender), framed(arrays[0]), framed(arrays[1]), framed(norm)), 256)


def strip_particle(token: Column, profile: Profile = KOREAN) -> Column:
    """Without the first particle of the list that ends it and leaves two characters or more."""
    if not profile.particles:
        return token
    return cascade([(token.endswith(p) & (F.length(token) - len(p) >= 2), F.substring(token, F.lit(1), F.length(token) - len(p))) for p in profile.particles], token)


def meaning_tokens(words: Column, profile: Profile = KOREAN) -> Column:
    """Distinct tokens without their particles, of two characters or more, that are no stop words."""
    stems = F.transform(words, lambda t: strip_particle(t, profile))
    return F.array_distinct(F.filter(stems, lambda t: (F.length(t) >= 2) & ~t.isin(*profile.stopwords)))


def strong_tokens(words: Column, profile: Profile = KOREAN) -> Column:
    """The meaning_tokens among the profile's strong ones, found before the others are looked at."""
    # Without particles there is nothing to strip, and the intersection needs no function for each token.
    stems = F.transform(words, lambda t: strip_particle(t, profile)) if profile.particles else words
    strong = [t for t in profile.strong_tokens if len(t) >= 2 and t not in profile.stopwords]
    return F.array_intersect(stems, strings(strong))


def similarity_tokens(words: Column, profile: Profile = KOREAN) -> Column:
    """Distinct tokens, trimmed and lower-case, without generic ones and blanks."""
    lower = F.transform(words, lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(lower, lambda t: (t != "") & ~t.isin(*profile.generic_tokens)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either has fewer than three."""
    few = (F.size(a) < 3) | (F.size(b) < 3)
    return F.when(few, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def categories(text: Column, profile: Profile = KOREAN) -> Column:
    """The categories of which a keyword, in lower case, is in the text, in the order of the list."""
    def named(lower: Column) -> Column:
        return F.filter(F.array(*[F.when(any_in(lower, [w.lower() for w in parts]), F.lit(name)) for name, parts in profile.categories]), lambda c: c.isNotNull())

    return once(squeeze(F.lower(F.coalesce(text, F.lit("")))), named)


def keyword_evidence(norm: Column, profile: Profile = KOREAN) -> Column:
    found = F.array(*[F.when(norm.contains(k), F.struct(F.lit("행동 유도 문구").alias("type"), F.lit(k).alias("detail"), F.lit(w).alias("weight"))) for k, w in profile.keywords])
    return F.filter(found, lambda e: e.isNotNull())


def text_evidence(domains: Column, norm: Column, blocked: Column | None = None, profile: Profile = KOREAN) -> Column:
    """Evidence of the text rules in order: blocked domains, shorteners, suspicious endings, keywords.

    blocked is an array of the message's domains that are on a block list; they have no ending
    weighed again.
    """
    blocked = F.array().cast("array<string>") if blocked is None else blocked
    item = lambda kind, detail, weight: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), F.lit(weight).alias("weight"))
    ending = lambda d: F.when(F.instr(d, ".") > 0, F.substring_index(d, ".", -1)).otherwise("")
    listed = F.transform(F.array_intersect(domains, blocked), lambda d: item("피싱 URL 명단", d, 0.5))
    short = F.transform(F.array_intersect(domains, strings(profile.text_shorteners)), lambda d: item("단축 URL", d, 0.2))
    odd = F.filter(F.array_except(domains, blocked), lambda d: ending(d).isin(*profile.text_tlds))
    endings = F.transform(odd, lambda d: item("의심 TLD", F.concat(F.lit("."), ending(d), F.lit(" ("), d, F.lit(")")), 0.15))
    return F.concat(listed, short, endings, keyword_evidence(norm, profile))


# --- The model's view of a text ------------------------------------------------------------------


def classified_urls(urls: Column, profile: Profile = KOREAN) -> Column:
    """The class token of each URL: official, shortener or, for any other, suspicious."""
    def host(u: Column) -> Column:
        h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(u)), "^https?://", ""), r"^www\.", "")
        return F.regexp_replace(F.regexp_extract(h, "^([^/?#]*)", 1), r"[.,!?;:)\]}\"']+$", "")

    return F.transform(
        urls, lambda u: F.when(in_domains(host(u), profile.official_domains), "[URL_OFFICIAL]").when(in_domains(host(u), profile.model_shorteners), "[URL_SHORTENER]").otherwise("[URL_SUSPICIOUS]")
    )


def phone_class(phone: Column, profile: Profile = KOREAN) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return cascade(
        [
            (F.trim(phone).startswith("+") & ~digits.startswith("82"), "[PHONE_FOREIGN]"),
            (digits.isin(*profile.official_numbers), "[PHONE_OFFICIAL]"),
            (digits.startswith("010"), "[PHONE_MOBILE]"),
            (digits.rlike(r"^(15|16|18)\d{6}$"), "[PHONE_OFFICIAL]"),
        ],
        "[PHONE_OTHER]",
    )


def _replaced(text: Column, pattern: str, classes) -> Column:
    """Each match of a pattern replaced by its class token, blanks around it."""
    gaps = F.split(text, pattern, -1)
    marks = classes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.array_join(F.flatten(F.zip_with(gaps, marks, lambda g, m: F.array(g, F.coalesce(F.concat(F.lit(" "), m, F.lit(" ")), F.lit(""))))), "")


def for_model(df: DataFrame, text: str = "text", name: str = "model_text", profile: Profile = KOREAN) -> DataFrame:
    """Append the text as a classifier reads it: NFKC, URLs and phone numbers as class tokens, squeezed."""
    rows = df.withColumn("_m", F.translate(nfkc(F.col(text)), "\r\n\t", "   "))
    rows = rows.withColumn("_m", _replaced(F.col("_m"), MODEL_URL, lambda u: classified_urls(u, profile)))
    rows = rows.withColumn("_m", _replaced(F.col("_m"), PHONE, lambda p: F.transform(p, lambda x: phone_class(x, profile))))
    return rows.withColumn(name, squeeze(F.col("_m"))).drop("_m")


def for_generated(df: DataFrame, text: str = "text", name: str = "model_text", profile: Profile = KOREAN) -> DataFrame:
    """Append the text as the generator of synthetic notices masks it, which differs from for_model.

    Any dotted name with an ending of letters is a URL; a host is what lies before the first slash,
    without "www." wherever it is. Numbers that begin with 1 and three digits are official, and all
    that are not known to be foreign or official are mobile ones.
    """
    def url_class(u: Column) -> Column:
        host = F.replace(F.lower(F.substring_index(F.regexp_replace(u, r"(?i)^https?://", ""), "/", 1)), F.lit("www."), F.lit(""))
        return F.when(in_domains(host, profile.official_domains), "[URL_OFFICIAL]").when(in_domains(host, profile.url_shorteners), "[URL_SHORTENER]").otherwise("[URL_SUSPICIOUS]")

    def number_class(phone: Column) -> Column:
        digits = F.regexp_replace(phone, r"\D", "")
        foreign = F.trim(phone).startswith("+") & ~digits.startswith("82")
        official = digits.isin(*profile.official_numbers) | (~digits.startswith("010") & digits.rlike("^(1[0-9]{3}|15|16|18)"))
        return F.when(foreign, "[PHONE_FOREIGN]").when(official, "[PHONE_OFFICIAL]").otherwise("[PHONE_MOBILE]")

    rows = df.withColumn("_m", F.translate(nfkc(F.col(text)), "\r\n\t", "   "))
    rows = rows.withColumn("_m", _replaced(F.col("_m"), GENERATED_URL, lambda u: F.transform(u, url_class)))
    rows = rows.withColumn("_m", _replaced(F.col("_m"), GENERATED_PHONE, lambda p: F.transform(p, number_class)))
    return rows.withColumn(name, squeeze(F.col("_m"))).drop("_m")


#: Class tokens and the names of their presence flags.
FLAGS = (
    ("[URL_OFFICIAL]", "has_official_url"), ("[URL_SHORTENER]", "has_shortener_url"), ("[URL_SUSPICIOUS]", "has_suspicious_url"),
    ("[PHONE_FOREIGN]", "has_foreign_phone"), ("[PHONE_OFFICIAL]", "has_official_phone"), ("[PHONE_MOBILE]", "has_mobile_phone"),
)


def with_flags(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({name: F.col(text).contains(token).cast("int") for token, name in FLAGS})


# --- Templates -----------------------------------------------------------------------------------

#: Slots of a template: pattern and replacement, in order; the patterns are fixed values.
SLOTS = (
    (r"[가-힣]{2,4}\s*(?=고객님|회원님|님)", " name_token "),
    (r"\d{1,2}\s*:\s*\d{2}\s*[~\-]\s*\d{1,2}\s*:\s*\d{2}", " time_range_token "),
    (r"\d{1,2}\s*:\s*\d{2}", " time_token "),
    (r"\d{1,3}(?:,\d{3})+\s*원", " amount_token "),
    (r"\d+\s*만\s*원", " amount_token "),
    (r"\d+\s*원", " amount_token "),
    (r"(?<!\d)\d{6,}(?!\d)", " long_number_token "),
    (r"\d+", " number_token "),
    (r"(ㅋ|ㅎ|ㅠ|ㅜ){2,}", "$1$1"),
    (r"[^0-9a-z가-힣_\[\]\s]", " "),
)
PROTECTED = ("url_official", "url_shortener", "url_suspicious", "phone_official", "phone_mobile", "phone_foreign", "phone_other")


def template(text: Column) -> Column:
    """The text's skeleton: slots as tokens, no special characters, class tokens kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for name in PROTECTED:
        out = F.replace(out, F.lit(f"[{name}]"), F.lit(f" {name}_token "))
    for pattern, to in SLOTS:
        out = F.regexp_replace(out, f"(?U){pattern}", to)
    out = squeeze(out)
    for name in PROTECTED:
        out = F.replace(out, F.lit(f"{name}_token"), F.lit(f"[{name.upper()}]"))
    return out


def family(text: Column, label: Column, profile: Profile = KOREAN) -> Column:
    """phishing for label 1, else the family of which a word is in the text, or other."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words, kinds, rest = profile.family_split
    kind = cascade([(any_in(lower, parts), F.lit(name)) for name, parts in kinds], rest)
    tests = [(label == 1, F.lit("phishing")), *((any_in(lower, parts), F.lit(name)) for name, parts in profile.families), (any_in(lower, words), kind)]
    return cascade(tests, "other")


def group_id(label: Column, family_: Column, template_: Column) -> Column:
    key = F.concat(F.lit("label="), label.cast("int").cast("string"), F.lit("|family="), family_, F.lit("|template="), template_)
    return F.substring(F.sha1(key.cast("binary")), 1, 16)


# --- Variants ------------------------------------------------------------------------------------


def variants(text: Column, profile: Profile = KOREAN) -> Column:
    """Array of (type, text): the evasions that change the text."""

    def rewrite(name: str, pairs: tuple[tuple[str, str], ...]) -> Column:
        start = F.regexp_replace(text, "(?i)https?://", "hxxp://") if name == "url_obfuscation" else text
        return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, start)

    made = F.array(*[F.struct(F.lit(n).alias("type"), rewrite(n, p).alias("text")) for n, p in profile.rewrites])
    return F.filter(made, lambda v: v["text"] != text)
