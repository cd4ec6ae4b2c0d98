"""The text queries that SQL cannot follow, against plain Python: every row of their tables, and hard texts."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewatch import lexicons as L
from tidewatch.functions import text as T
from tidewatch.plans import text_queries as Q


def python(pattern):
    """A pattern for Python's re, whose classes are those of Unicode without being asked."""
    flags = re.I if "i" in re.match(r"\(\?(\w+)\)|", pattern).group(0) else 0
    return re.compile(re.sub(r"^\(\?\w+\)", "", pattern), flags)


MASK, FIND, MODEL, PHONE, TRAIL = (python(p) for p in (L.MASK_URL, L.FIND_URL, L.MODEL_URL, L.PHONE, L.URL_PARTICLES))
CHARS = r"A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\-"
GONE = {0x200B: None, 0xFEFF: None}


def nfkc(t):
    return unicodedata.normalize("NFKC", t or "")


def squeeze(t):
    return re.sub("^ | $", "", re.sub(r"\s+", " ", t))


def norm(t):
    return squeeze(nfkc(t).translate(GONE))


def urls(t):
    t = re.sub(r"(?i)\b(https?://)\s+", r"\1", nfkc(t).translate(GONE))
    for _ in range(5):
        t = re.sub(rf"(?i)(https?://[{CHARS}]*)[\r\n\t ]+(?=[{CHARS}])", r"\1", t)
    t = re.sub(r"(?i)\bbit\s*/\s*ly\b", "bit.ly", t)
    found = [TRAIL.sub("", re.sub(r"[.,);\]}>。，]+$", "", m.group(0))) for m in FIND.finditer(t)]
    return list(dict.fromkeys(u for u in found if u))


def host(u):
    u = u.strip(" ").lower()
    u = u if re.match(r"[a-z][a-z0-9+.-]*://", u) else "http://" + u
    h = re.sub("^.*@", "", re.match(r"[^:/?#]*://([^/?#]*)", u).group(1))
    h = re.match(r"\[([^\]]*)\]", h).group(1) if re.match(r"\[([^\]]*)\]", h) else "" if h.startswith("[") else h.split(":")[0]
    return re.sub(r"^\.+|\.+$", "", re.sub(r"^www\.", "", h))


def masked(t):
    return MASK.sub("[URL]", norm(t))


def words(t):
    return re.findall(r"[0-9A-Za-z가-힣]+", masked(t))


def model_view(t):
    def url_class(m):
        h = re.sub(r"^www\.", "", re.sub("^https?://", "", m.group(0).strip(" ").lower()))
        h = re.sub(r"[.,!?;:)\]}\"']+$", "", re.match("[^/?#]*", h).group(0))
        under = lambda ds: any(h == d or h.endswith("." + d) for d in ds)
        return f" [URL_{'OFFICIAL' if under(L.OFFICIAL_DOMAINS) else 'SHORTENER' if under(L.MODEL_SHORTENERS) else 'SUSPICIOUS'}] "

    def phone_class(m):
        d = re.sub(r"\D", "", m.group(0))
        if m.group(0).strip(" ").startswith("+") and not d.startswith("82"):
            kind = "FOREIGN"
        elif d in L.OFFICIAL_NUMBERS:
            kind = "OFFICIAL"
        else:
            kind = "MOBILE" if d.startswith("010") else "OFFICIAL" if re.fullmatch(r"(15|16|18)\d{6}", d) else "OTHER"
        return f" [PHONE_{kind}] "

    t = MODEL.sub(url_class, re.sub("[\r\n\t]", " ", nfkc(t)))
    return squeeze(PHONE.sub(phone_class, t))


HARD = [
    "[Web발신] CJ대한통운 배송조회 https:// cjlogistics.com/a?b=1 를 확인", "go http://bit.ly/x, www.Example.COM/p) and bit / ly", "a@b.com kim.test.kr에서 x.y", "１２３ ａｂｃ．ｃｏｍ ﬁ", "국제 +1 202 5550 1234 010-1234-5678 15881255 1588-1300 02-123-4567",
    "https://192.168.0.1:8080/p\n/q 끝", "​zero﻿width", "", None, " \t\n ", "kbcard.com kbstar.com me2.do/x evil.kbcard.com.xyz", "http://user@host.org:80/#f 입니다.", "plain words only", "hanjin.com은 안전", "...com .com a..b",
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(HARD)], "id int, text string, sender string")


def test_hard_texts(hard):
    got = {r.id: r for r in T.with_flags(T.for_model(T.preprocess(hard), name="model_text"), "model_text").collect()}
    for i, t in enumerate(HARD):
        r = got[i]
        assert (r.norm, r.urls, r.masked, r.tokens) == (norm(t), urls(t), masked(t), words(t)), t
        assert r.domains == list(dict.fromkeys(h for h in map(host, urls(t)) if h)), t
        assert r.model_text == model_view(t), t
        assert {name: r[name] for _, name in T.FLAGS} == {name: int(mark in r.model_text) for mark, name in T.FLAGS}


def rows(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


def test_nfkc_normalize(spark, sf):
    want = {r.doc_id: hashlib.sha256(norm(r.text).encode()).hexdigest() for r in rows(spark, sf, "documents")}
    assert {r.doc_id: r.norm_sha256 for r in Q.nfkc_normalize(spark, sf).collect()} == want


def test_preprocess_messages(spark, sf):
    want = {(r.conv_id, r.turn): (urls(r.text), list(dict.fromkeys(h for h in map(host, urls(r.text)) if h)), len(words(r.text)), len(masked(r.text))) for r in rows(spark, sf, "conversations")}
    assert {(r.conv_id, r.turn): (r.urls, r.domains, r.n_tokens, r.masked_length) for r in Q.preprocess_messages(spark, sf).collect()} == want


def test_document_urls(spark, sf):
    want = sorted((r.doc_id, u) for r in rows(spark, sf, "documents") for u in urls(r.text))
    got = Q.document_urls(spark, sf)
    assert sorted((r.doc_id, r.url) for r in got.collect()) == want and want
    # The score is that of the URL's rules, which have SQL of their own.
    from tidewatch.functions import urls as U

    again = U.url_rules(spark.createDataFrame(want, "doc_id long, url string"), profile=L.ENGLISH).select("doc_id", "url", "rule_score")
    assert got.exceptAll(again).isEmpty() and again.exceptAll(got).isEmpty()


def test_token_presence_flags(spark, sf):
    names = [name for _, name in T.FLAGS]
    want = {r.doc_id: tuple(int(mark in model_view(r.text)) for mark, _ in T.FLAGS) for r in rows(spark, sf, "documents")}
    assert {r.doc_id: tuple(r[n] for n in names) for r in Q.token_presence_flags(spark, sf).select("doc_id", *[F.col(n).cast("int").alias(n) for n in names]).collect()} == want
