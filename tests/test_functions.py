import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import feed as A
from tidewatch.functions import scoring as S
from tidewatch.functions import text as T
from tidewatch.functions import urls as U
from tidewatch.lexicons import KOREAN, REVIEWS


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("https://www.a.com:80/x", "a.com"), ("a.com", "a.com"), ("http://u@h.com", "h.com"), ("http://192.168.0.1/login", "192.168.0.1"), ("http://exa_mple.com", "exa_mple.com"),
        ("", ""), (None, ""), ("HTTP://A.B.Com./p?q#f", "a.b.com"), ("http://a.com?x=1", "a.com"), ("http://[::1]:80/", "::1"),
    ],
)
def test_host(spark, url, host):
    assert one(spark, url, U.host_of(F.col("x"))) == host


@pytest.mark.parametrize(
    ("url", "score"),
    [
        ("http://192.168.0.1/login", 0.45), ("http://bit.ly/x", 0.25), ("http://a.top", 0.20), ("http://xn--a.com", 0.20), ("http://u@h.com", 0.25), ("http://a1.bcdef.com", 0.0),
        ("http://1abcd.efgh", 0.08), ("http://1abc", 0.15 if 1 / 4 >= 0.2 else 0), ("http://a.b.cd.com", 0.08), ("http://a.b.c.de.com", 0.15), ("", 0.0), ("http://h.com:99999/", 0.15 * 0),
    ],
)
def test_url_rules(spark, url, score):
    row = U.url_rules(spark.createDataFrame([(url,)], "url string")).first()
    assert row.rule_score == pytest.approx(score) and row.is_suspicious == (score >= 0.20)


def test_url_features(spark):
    r = U.url_features(spark.createDataFrame([("a-b.Example.com/p_q?x=1&y=&x=2#f%20",)], "url string")).first()
    assert (r.url_length, r.slash_count, r.query_param_count, r.host_hyphen_count, r.subdomain_count, r.percent_count) == (42, 3, 2, 1, 1, 1)
    assert U.url_features(spark.createDataFrame([("http://h:99999/",)], "url string")).first().has_port == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abc.é12", max_size=12))
def test_entropy(spark, text):
    want = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0
    assert one(spark, text, U.entropy(F.col("x"))) == pytest.approx(want, abs=1e-9)


def test_preprocess(spark):
    text = "ⓗttps://\nplay.google.com/ store 확인 asq.kr에서 me@mail.com bit/ly　끝."
    r = T.preprocess(spark.createDataFrame([(text, "  ")], "text string, sender string")).first()
    assert r.sender is None and "　" not in r.norm and "asq.kr" in r.urls and "bit.ly" in r.urls and "asq.kr" in r.domains
    assert any(u.startswith("https://play.google.com/store") for u in r.urls)
    assert one(spark, "see http://a.b/c, x", T.mask_urls(F.col("x"))) == "see [URL] x"
    assert one(spark, None, T.normalize(F.col("x"))) == ""


def test_tokens(spark):
    df = spark.createDataFrame([(["계좌가", "절차를", "은행", "a", "계좌"], ["A", "url", "b", "c"], ["a", "b", "c", "d"])], "t array<string>, a array<string>, b array<string>")
    r = df.select(T.meaning_tokens(F.col("t")).alias("m"), T.strong_tokens(F.col("t")).alias("s"), T.jaccard(T.similarity_tokens(F.col("a")), F.col("b")).alias("j"), T.jaccard(F.slice("b", 1, 2), F.col("b")).alias("z")).first()
    assert (r.m, r.s, r.j, r.z) == (["계좌", "절차"], ["계좌"], 0.75, 0.0)


def test_model_text_template_and_family(spark):
    df = spark.createDataFrame([("CJ택배 배송완료 hanjin.com bit.ly/x evil.top 010-1234-5678 1588-1255 +1 555 5555 국제",)], "text string")
    r = T.with_flags(T.for_model(df), "model_text").first()
    assert [r.has_official_url, r.has_shortener_url, r.has_suspicious_url, r.has_mobile_phone, r.has_official_phone] == [1, 1, 1, 1, 1]
    assert one(spark, "홍길동 고객님 12:30~13:30 1,200원 3만원 1234567 12 ㅋㅋㅋㅋ!! [URL_OFFICIAL]", T.template(F.col("x"))) == (
        "name_token name_token 님 time_range_token amount_token amount_token long_number_token number_token [URL_OFFICIAL]"
    )
    fam = df.select(T.family(F.col("text"), F.lit(0)).alias("a"), T.family(F.col("text"), F.lit(1)).alias("b")).first()
    assert (fam.a, fam.b) == ("cj_complete", "phishing")


def test_case_key_keeps_fields_apart(spark):
    rows = [(None, ["a"], ["u"], "t"), ("", ["a"], ["u"], "t"), (None, ["a", "u"], [], "t"), (None, ["a"], ["u"], "t")]
    df = spark.createDataFrame(rows, "s string, d array<string>, u array<string>, n string")
    keys = [r.k for r in df.select(T.case_key(F.col("s"), F.col("d"), F.col("u"), F.col("n")).alias("k")).collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[3]


def test_variants(spark):
    got = one(spark, "계좌 정지 http://a.com", T.variants(F.col("x")))
    assert {v.type for v in got} == {"spacing", "special_character", "english_mix", "url_obfuscation", "hangul_split"}
    assert next(v.text for v in got if v.type == "url_obfuscation") == "계좌 정지 hxxp://a[.]com"
    assert one(spark, "plain", T.variants(F.col("x"))) == []


def test_fusion_levels_and_caps(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.5, 0.5, 0.5), (2.0, -1.0, 0.0)], "m double, r double, p double")
    assert [r.s for r in df.select(S.fuse(F.col("m"), F.col("r"), F.col("p")).alias("s")).collect()] == [0.0, 1.0, 0.875, 1.0]
    levels = spark.createDataFrame([(0.39,), (0.40,), (0.6999,), (0.70,)], "s double").select(S.level(F.col("s")).alias("l")).collect()
    assert [r.l for r in levels] == ["safe", "suspicious", "suspicious", "danger"]
    caps = spark.createDataFrame([(0.0, 0.0, False), (0.3, 0.0, False), (0.3, 0.3, False), (0.3, 0.3, True)], "r double, p double, s boolean")
    assert [r.c for r in caps.select(S.displayed(F.lit(0.99), F.col("r"), F.col("p"), F.col("s")).alias("c")).collect()] == [0.70, 0.93, 0.96, 0.98]


def test_uncertainty_and_benign(spark):
    rows = [(0.9, 0.0, 0.0, 0.9, False), (0.1, 0.4, 0.4, 0.8, False), (0.5, 0.0, 0.0, 0.5, False), (0.9, 0.4, 0.4, 0.99, False), (0.1, 0.0, 0.0, 0.1, False)]
    df = spark.createDataFrame(rows, "m double, r double, p double, s double, c boolean")
    out = df.withColumns(S.uncertainty(F.col("m"), F.col("r"), F.col("p"), F.col("s"), F.col("c"))).collect()
    assert [(r.review_required, r.confidence) for r in out] == [(True, "low"), (True, "low"), (True, "low"), (False, "high"), (False, "high")]
    assert out[0].review_reason == REVIEWS[1] and out[1].review_reason == REVIEWS[2] and out[4].review_reason is None and out[4].signal_agreement == 1.0
    text = spark.createDataFrame([("카드 이용금액 정상 승인",), ("정상 승인 아래 링크",)], "t string")
    none = F.array().cast("array<string>")
    got = text.select(S.benign_adjusted(F.col("t"), F.lit(0.99), F.lit(0.0), F.lit(0.0), none, F.lit(False)).alias("s")).collect()
    assert [r.s for r in got] == [0.25, 0.99]


def test_evidence_and_reasons(spark):
    item = "struct<type:string,detail:string,weight:double>"
    e = [("단축 URL", "a", 0.2), ("단축 URL", "b", 0.2), ("행동 유도 문구", "x", 0.1), ("행동 유도 문구", "y", 0.1), ("행동 유도 문구", "x", 0.1)]
    df = spark.createDataFrame([(e,)], f"e array<{item}>").withColumn("d", S.distinct_evidence(F.col("e")))
    r = df.select("d", S.reasons(F.col("d"), F.lit("danger"), F.lit(0.93), F.lit("조직-0"), F.lit(3)).alias("s")).first()
    assert [x.detail for x in r.d] == ["a", "x", "y"] and len(r.s) == 4 and "93%" in r.s[0] and "'x', 'y'" in r.s[2] and "3건" in r.s[3]


def test_feed_titles(spark):
    assert one(spark, "2026.8.6 x", A.iso_date(F.col("x"))) == "2026-08-06" and one(spark, "none", A.iso_date(F.col("x"))) == ""
    title = "[KISA] 택배 사칭 스미싱·보이스피싱 주의"
    assert one(spark, title, A.category(F.col("x"))) == "피싱·스미싱" and one(spark, title, A.is_alert(F.col("x")))
    assert one(spark, title, A.keywords(F.col("x"))) == ["택배", "KISA", "스미싱", "피싱", "보이스피싱"] and one(spark, "x", A.keywords(F.col("x"))) == [KOREAN.title_default]
    assert "'택배" in one(spark, title, A.summary(F.lit("KISA"), F.col("x")))


BASES = ["https://a.com/x/y/list.do?q=1", "https://a.com", "http://a.com/p/"]
HREFS = ["view.do?n=1", "/view.do", "../z/v.do", "./k", "../../../u", "//b.org/q", "http://c.net/a/../b", "?p=2", "#top", "", "a/b/../c/./d", "mailto:x@y", "..", ".", "/a/../b/./c", "x/", "/", "javascript:"]


def test_resolved_is_urljoin(spark):
    from urllib.parse import urljoin

    rows = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b string, h string").select("b", "h", U.resolved(F.col("b"), F.col("h")).alias("r"))
    assert all(r.r == urljoin(r.b, r.h) for r in rows.collect())
    assert one(spark, "https://a.com/x#f", U.resolved(F.col("x"), F.lit(None))) == "https://a.com/x"
    assert one(spark, "v.do", U.resolved(F.lit("https://a.com/x/y#f"), F.col("x"))) == "https://a.com/x/v.do"


def test_normal_form_of_plain_and_other_texts(spark):
    import unicodedata

    texts = ["plain text", "ｆｕｌｌ ①", "é", "한글", "", None, "ﬁ"]
    got = [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.nfkc(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKC", t or "") for t in texts]


def test_address_variants_follow_urlparse(spark):
    from urllib.parse import urlparse

    typed = ["HTTP://WWW.A.com:80/P?q=1&r#f", "a.com", "www.x.y.z/path", " b c.com ", "ftp://u:p@h.org/a;b?c", "localhost", "", None, "http://[::1]:8/x", ".a.com.", "example.com?x=http://b.c", "https://k"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, u string")
    got = rows.select("i", U.url_parts(F.col("u")).alias("p"), U.page_tld(F.col("u")).alias("t"), U.dataset_url(F.col("u")).alias("d"), U.dataset_domain(F.col("u")).alias("h")).orderBy("i").collect()
    for t, r in zip(typed, got, strict=True):
        v = (t or "").strip().lower()
        full = v if not v or "://" in v else "http://" + v
        p = urlparse(full)
        host = (p.hostname or "").removeprefix("www.")
        labels = [x for x in host.split(".") if x]
        assert tuple(r.p) == (p.scheme, host, p.path + (";" + p.params if p.params else ""), p.query, labels[-1] if labels else ""), t
        assert r.t == (labels[-1] if len(labels) > 1 else "")
        d = v.replace(" ", "")
        d = d if not d or d.startswith(("http://", "https://")) else "http://" + d
        assert (r.d, r.h) == (d, (urlparse(d).hostname or "").removeprefix("www.").strip(".")), t


def test_addresses_with_parts_in_any_order(spark, sf):
    """Hosts that are no addresses raise no error where a join's sides are filtered on the host by themselves."""
    from tidewatch.plans.evaluation_queries import balanced_urls

    def rows():
        return sorted(map(tuple, balanced_urls(spark, sf).collect()))

    broadcast = rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcast and rows() == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_categories_squeeze_a_text_once(spark):
    """The text is squeezed once for all keywords: two replacements in the plan, however many keywords there are."""
    from tidewatch.lexicons import ENGLISH

    df = spark.createDataFrame([("With  the\tPASSWORD",), (None,), ("x NICHT y @",)], "t string").select(T.categories(F.col("t"), ENGLISH).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert [r.c for r in df.collect()] == [["connectives", "articles", "credentials"], [], ["contacts", "negations"]]
