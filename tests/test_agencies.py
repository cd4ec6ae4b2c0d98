"""The walk from list pages to items, on hand-made boards."""

from tidewatch.operators import agencies as G

KISA_LIST = """<table><tr><th>제목</th></tr>
<tr><td><a href="javascript:" data-id="11" class="x nttInfoBtn">스미싱 &amp; 피싱 <b>주의</b></a></td><td>2024.1.2</td></tr>
<tr><td><a href="javascript:" data-id='' class="nttInfoBtn">피싱 번호 없음</a></td><td>2024.1.3</td></tr>
<tr><td><a href="#" data-id="12" class="other">피싱 다른 링크</a></td></tr>
<tr><td><a data-id=13 class=nttInfoBtn>날씨 안내</a></td></tr></table><a class="nttInfoBtn" data-id="14">보이스피싱 표 밖</a>"""
POLICE_LIST = """<table><tr><td><a href="BD_selectBbs.do?q_bbsCode=1002&amp;q_bbscttSn=77">피싱 검거</a></td><td>2024-03-04</td></tr>
<tr><td><a href='/user/bbs/BD_selectBbs.do?q_bbsCode=1002&q_bbscttSn=77'>피싱 검거 다시</a></td></tr>
<tr><td><a href="../bbs/BD_selectBbs.do?other=1">사칭 주의</a></td><td>2024/5/6</td></tr><tr><td><a href="/else.do">피싱</a></td></tr></table>"""
FSS_LIST = """<table><tr><td><a href="./view.do?nttId=5&menuNo=1">보이스피싱 경보</a></td><td></td></tr><tr><td><a href="/x/view.do?nttId=6">금융사기 경보</a></td><td>2023-12-1</td></tr></table>"""
BODY = "이 글은 보이스피싱 수법을 알리고 대응 방법을 안내하는 긴 본문입니다. " * 8


def test_three_agencies(spark):
    pages = [
        (G.KISA.list_url, KISA_LIST), (G.POLICE.list_url, POLICE_LIST), (G.FSS.list_url, FSS_LIST), (G.KISA.detail.format(11), f"<div class='menu'>짧은</div><div class=\"a view_cont\"><p>{BODY}</p></div>"),
        ("https://www.fss.or.kr/fss/bbs/B0000175/view.do?nttId=5&menuNo=1", "<p>등록일 2024.7.8</p>"), ("https://www.fss.or.kr/fss/bbs/B0000175/view.do?nttId=5&menuNo=1", "<p>등록일 2024.7.8</p>"), (None, None),
    ]
    df = spark.createDataFrame(pages, "url string, html string").repartition(3)
    got = {a.source: {r.id: r for r in G.items(df, a).collect()} for a in G.AGENCIES}
    kisa, police, fss = got["KISA"], got["경찰청"], got["금융감독원"]
    assert {(r.id, r.title, r.published_at) for r in kisa.values()} == {("kisa-11", "스미싱 & 피싱 주의", "2024-01-02"), ("kisa-14", "보이스피싱 표 밖", "")}
    assert kisa["kisa-11"].url == G.KISA.detail.format(11) and kisa["kisa-11"].category == "스미싱" and kisa["kisa-11"].summary.startswith("KISA에서 '스미싱 & 피싱 주의'")
    assert {(r.title, r.published_at) for r in police.values()} == {("피싱 검거", "2024-03-04"), ("사칭 주의", "2024-05-06")}
    assert police["police-77"].url == "https://www.police.go.kr/user/bbs/BD_selectBbs.do?q_bbsCode=1002&q_bbscttSn=77"
    assert all(i.startswith("police-") and len(i) == 47 for i in police if i != "police-77")
    assert {(r.id, r.published_at) for r in fss.values()} == {("fss-5", "2024-07-08"), ("fss-6", "2023-12-01")}
    assert G.items(df, G.FSS, limit=1).count() == 1 and G.items(df.where("false"), G.KISA).count() == 0
    bodies = {r.url: r.body for r in G.details(df, G.items(df, G.KISA), ("missing", "view_cont", "article")).collect()}
    assert list(bodies) == [G.KISA.detail.format(11)] and bodies[G.KISA.detail.format(11)] == BODY.strip()[:220] + "..."


def test_links_take_their_innermost_row(spark):
    html = "<table><tr><td>2020.1.1<table><tr><td>2021.2.3 <a href=a>in</a></td></tr></table></td></tr></table>"
    rows = G.list_links(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(r.title, r.row[:8]) for r in rows] == [("in", "2021.2.3")]


def test_query_keeps_references_in_headings(spark, tmp_path):
    """Titles of the query as its SQL has them: tags gone, & for &amp;, other references as they are."""
    from tidewatch.plans.feed_queries import agency_items

    heads = ["The token = &quot;0cf1", "The <b>a</b> &amp; b", "The &amp;quot; &lt;x&gt; &nbsp; &#39;", "The 3 < 4", None, "The plain"]
    pages = [(i, f"https://a.com/{i}", f"<h1>{h}</h1>" if h else "<p>The</p>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {int(r.id.rsplit("-")[1]): r.title for r in agency_items(spark, str(tmp_path)).collect()}
    assert got == {0: "The token = &quot;0cf1", 1: "The a & b", 2: "The &quot; &lt;x&gt; &nbsp; &#39;", 3: "The 3 < 4", 5: "The plain"}
