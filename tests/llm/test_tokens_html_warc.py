import base64
import hashlib
import html
import html.parser
import random

import pytest

from tidewatch.llm import html_main_text as H
from tidewatch.llm import token_counts as K
from tidewatch.llm import warc_derivatives as V


def greedy(word, pieces):
    word, n = word + b"\0", 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return -1
        word, n = word[k:], n + 1
    return n


def test_counts_are_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) + rng.choice([b"", b"\0"]) for _ in range(rng.randint(1, 14))}
        a = K.Automaton(sorted(pieces))
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 10)))
            assert a.count(w) == greedy(w, pieces)
    assert K.Automaton([b"a", b"\0"]).count(b"a\0a") == -1


def test_token_counts_of_odd_rows(odd, none):
    pieces = [bytes([b]) for b in range(1, 256)] + [b"\0", b"ab", b"one\0", b"cd\0"]
    rows = {r.doc_id: r for r in K.token_counts(odd, pieces, keep=["doc_id"]).collect()}
    assert (rows[33].n_words, rows[33].n_tokens, rows[33].n_unknown) == (1, 1, 0)
    assert rows[30].n_tokens == rows[31].n_tokens == rows[32].n_tokens == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert rows[40].n_tokens == sum(greedy(w, set(pieces)) for w in texts[40].encode().lower().split())
    assert K.token_counts(none, pieces).count() == 0
    few = {r.doc_id: r for r in K.token_counts(odd, [b"o", b"n"], keep=["doc_id"]).collect()}
    assert (few[33].n_tokens, few[33].n_unknown) == (1, 1)


def test_vocabulary_spells_every_byte():
    try:
        pieces = K.load_vocabulary()
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    known = set(pieces)
    assert all(bytes([b]) in known for b in range(1, 256)) and max(map(len, pieces)) > 5


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav>
<div class="cookie-notice"><p>We use cookies on this very long page of ours, please agree to them all.</p></div>
<article><h1>Head&amp;line</h1><p><b>First &eacute;&nbsp;text<br>goes   on.<p>Short.</p><script>var a="</p>";</script><figure><img src=x></figure><ul><li>One<li>Two</ul>
<form><input><p>Sign up now</p></form><section class="comments"><p>Great article, I liked it a lot and will return!</p></section></article>
<aside><p>Side text</p></aside><footer>&copy; us</footer>"""


def test_main_text():
    assert H.main_text(PAGE) == "Head&line First é text goes on. Short. One Two"
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<p>just &lt;text&gt;") == "just <text>"
    soup = '<div id=menu><a href=a>one</a> <a href=b>two</a></div><div class=post><h2>Title</h2><p>' + "many words here " * 20 + "</p><p>Ok.</p></div><div class=links><a href=c>more to read</a></div>"
    assert H.main_text(soup) == ("Title " + "many words here " * 20 + "Ok.").strip()
    for broken in ("<", "<p", "<!--", "</p></p>", "<![CDATA[x", "&#xFFFFFFF;", "<a href='", "<script>x"):
        H.main_text(broken)


def test_extract_on_the_driver_table(spark, sf):
    import re

    rows = H.extract(spark.read.parquet(f"{sf}/pages.parquet"), keep=["page_id", "url", "html"]).collect()
    for r in rows:
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        text = re.sub(r"</?(b|i|a)\b[^>]*>", "", body)
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", text)).split()) and r.n_chars == len(r.text)


def test_derivatives_link_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<title>T &amp; t</title><p>Hello<p>w&eacute;lt <a href=x>l</a>"), (2, None, None), (None, "http://b", ""), (1, "http://a/1", "<p>x")], "page_id long, url string, html string")
    rows = V.derivatives(V.responses_from_pages(pages), keep=["page_id"]).cache()
    got = rows.collect()
    assert len(got) == 8 and {r.warc_type for r in got} == {"metadata", "conversion"}
    first = next(r for r in got if r.warc_type == "conversion" and "Hello" in r.content)
    assert first.content == "T & t\nHello\nwélt l"  # a title outside a head is a block of its own
    described = next(r.content for r in got if r.warc_type == "metadata" and "T & t" in r.content)
    assert "title: T & t\r\n" in described and "outlinks: 1\r\n" in described
    for r in got:
        assert r.content_length == len(r.content.encode())
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.content.encode()).digest()).decode()
    meta = [r for r in got if r.warc_type == "metadata"]
    assert all(any(c.record_id in m.content and c.refers_to == m.refers_to for c in got if c.warc_type == "conversion") for m in meta)
    for kind in ("none", "gzip"):
        V.write_records(rows, str(tmp_path / kind), kind)
        back = V.read_records(spark, str(tmp_path / kind)).collect()
        assert all(b.whole for b in back)
        assert sorted((b.headers["warc-record-id"], b.headers.get("warc-refers-to", ""), b.block) for b in back) == sorted((r.record_id, r.refers_to, r.content) for r in got)


def test_digests_and_other_kinds(spark):
    body = b"\x89PNG"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nX-A: b\r\n\r\n" + body
    given = V.digest(body)
    rows = [("<urn:1>", "http://i", "d", block, given), ("<urn:2>", "http://i", "d", block, "sha1:X"), ("<urn:3>", None, None, None, None)]
    got = V.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary, payload_digest string")).collect()
    by = {(r.refers_to, r.warc_type): r for r in got}
    assert ("<urn:1>", "conversion") not in by and by["<urn:1>", "metadata"].source_digest_matches is True
    assert by["<urn:2>", "metadata"].source_digest_matches is False and "http-header: X-A: b" in by["<urn:2>", "metadata"].content
    assert by["<urn:3>", "conversion"].content == ""


LONG = "many plain words of a paragraph here " * 6


def test_a_head_without_an_end_tag():
    for page in ("<head><title>T</title><body><p>{}</p>", "<html><head><meta charset=x><title>T</title><p>{}", "<head><script>a='<div>'</script><title>T</title><div>{}</div>", "<head><title>T</title>{}"):
        assert H.main_text(page.format("Some words")) == "Some words"
        assert V.plain_text(page.format("Some words")) == "Some words"
    closed = "<head><title>T</title><noscript><p>no</p></noscript><style>p</style><script>'<body>'</script></head><body><header>Top</header><p>Yes"
    assert H.main_text(closed) == "Yes" and V.plain_text(closed) == "Top\nYes"


def test_a_wrapper_with_a_mark_is_not_barred():
    for names in ("content has-sidebar", "sidebar-layout", "page search"):
        page = f"<body><div class='{names}'><h1>Title</h1><p>{LONG}</p><p>Ok.</p><div class=comments><p>{LONG * 9}</p></div></div>"
        assert H.main_text(page) == f"Title {LONG.strip()} Ok."
    page = f"<div class='sidebar-layout'><div class=Related><article>Teaser</article></div><article><p>{LONG}</article></div><p>{LONG}"
    assert H.main_text(page) == LONG.strip()
    for names in ("Comments", "comment-list", "user-feedback"):
        assert H.main_text(f"<p>{LONG}</p><div class='{names}'><p>{LONG}</p></div>") == LONG.strip()


def test_names_do_not_decide():
    """What a box says and not how it is called: notices without text go, article text under any name stays."""
    p, words = f"<p>{LONG}</p>", LONG.strip()
    assert H.main_text(f"<article>{p}<div class='gdpr-bar'>We use cookies <b>OK</b></div>{p}{p}</article>") == f"{words} {words} {words}"
    assert H.main_text(f"<article>{p}{p}</article><div class='user-feedback'>{p * 4}</div>") == f"{words} {words}"
    assert H.main_text(f"<article>{p}<div class=social>{p}</div>{p}</article>") == f"{words} {words} {words}"
    assert H.main_text(f"<article>{p}<section id=search><h2>The search</h2>{p}</section></article>") == f"{words} The search {words}"
    assert H.main_text(f"<article>{p}<div class=note><p><a href=s>The source</a></p></div>{p}</article>") == f"{words} The source {words}"


def test_short_parts_of_an_article_stay():
    for part in ("<ul><li>One<li>Two</ul>", "<blockquote>One Two</blockquote>", "<table><tr><td>One<td>Two</table>", "<section><p>One</p><p>Two</p></section>"):
        for page in ("<div class=post><p>{0}</p>{1}<p>{0}</p></div>", "<body><p>{0}</p><p>{0}</p><p>{0}</p>{1}<p>{0}</p>"):
            assert H.main_text(page.format(LONG, part)).count("One Two") == 1
        assert H.main_text(f"<div class=post><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{part}</div><div><a href=x>more</a></div>").endswith("One Two")


def layouts(n, seed):
    """Pages of five layouts without an article element, with made-up names, and their article's text."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    mark = lambda: rng.choice([f'class="{word()}-{rng.randint(1, 99)}"', f'id="{word()}"', f'class="{word()} {word()}"'])
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k))

    def junk():
        kinds = [f"{words(3, 7)}", f"<span>{words(2, 4)}</span> <b>{words(1, 3)}</b>", f'<p>{words(3, 6)} <a href="#">{words(1, 2)}</a></p>', f"<ul>{links(4)}</ul>"]
        return f"<div {mark()}>{rng.choice(kinds)}</div>"

    for _ in range(n):
        truth = []

        def say(text, tag="p", truth=truth):
            truth.append(text)
            return f"<{tag}>{text}</{tag}>"

        paras = lambda a, b, say=say: "".join(say(words(18, 90)) if rng.random() < 0.85 else say(words(3, 8)) for _ in range(rng.randint(a, b)))
        start = lambda say=say: say(words(3, 9), "h1") + say(words(30, 70)) + say(words(30, 70))
        menu = f"<div {mark()}><ul>{links(rng.randint(3, 9))}</ul></div>"
        comments = "".join(f"<div {mark()}><b>{word()}</b><i>{word()}</i><p>{words(2, 6)}</p></div>" for _ in range(rng.randint(2, 6)))
        kind = rng.randrange(5)
        if kind == 0:
            page = f"{menu}<div {mark()}>{start()}{paras(2, 6)}</div>{junk()}<div {mark()}>{words(4, 8)}</div>"
        elif kind == 1:
            page = f"{menu}<div {mark()}><div>{start()}{paras(1, 3)}</div>{junk()}<div>{paras(1, 3)}</div></div>{junk()}"
        elif kind == 2:
            page = f"<div {mark()}>{menu}{junk()}<div {mark()}>{start()}{paras(2, 5)}</div><div {mark()}>{comments}</div></div>"
        elif kind == 3:
            page = f"<table><tr><td>{links(3)}</td></tr></table><div {mark()}><section {mark()}>{start()}</section>{junk()}<section {mark()}>{say(words(30, 60))}{paras(1, 3)}</section>{junk()}</div>"
        else:
            page = f"{menu}<main>{junk()}<div {mark()}>{start()}{paras(1, 4)}</div>{junk()}{comments}</main>"
        out.append((f"<html><head><title>{word()}</title></head><body>{page}</body></html>", " ".join(truth)))
    return out


def test_the_ratio_selects(monkeypatch):
    """On layouts without an article element 19 of 20 texts are whole; without the cut, or with flat ratios, over half of all pages change."""
    pages = layouts(200, 11)
    found = [H.main_text(h) for h, _ in pages]
    assert sum(f == t for f, (_, t) in zip(found, pages, strict=True)) >= 190
    assert sum(H.main_text(h, 1e-9) != f for f, (h, _) in zip(found, pages, strict=True)) >= 100
    assert sum(H.main_text(h, sigma=1e-3) != f for f, (h, _) in zip(found, pages, strict=True)) >= 2
    monkeypatch.setattr(H, "smooth_runs", lambda values, key, sigma: values * 0 + 1)
    assert sum(H.main_text(h) != f for f, (h, _) in zip(found, pages, strict=True)) >= 100


def test_what_belongs_to_an_article():
    assert H.main_text("<a href=a>one</a> <a href=b>two</a>") == ""
    p = f"<p>{LONG}</p>"
    words = LONG.strip()
    for box in ("<div><b>Ann</b><p>Great article, I liked it</p></div><div><b>Bob</b><p>Me too</p></div>", "<div><b>Ann</b><i>today</i><p>Great article, I liked it a lot and will return!</p></div>"):
        assert H.main_text(f"<article>{p * 3}<div class='user-feedback'>{box}</div></article>") == " ".join([words] * 3)
    for around in ("<body>{}</body>", "<main>{}</main>"):
        assert H.main_text(around.format(f"<article><h1>Story</h1>{p}{p}</article><article><h2>Teaser</h2><p>Come and read</p></article>")) == f"Story {words} {words}"
    assert H.main_text(f"<article>{p}<p class='share-price'>12.5 up</p><p class='social-policy'>policy</p>{p}</article>") == f"{words} 12.5 up policy {words}"
    assert H.main_text(f"<article>{p}<article class=x>{p}</article></article>") == words
    layout = f"<body><div class=top><a href=x>Home</a></div><div class=wide><div class=left><ul><li><a>1</a><li><a>2</a></ul></div><div class=mid><h1>T</h1>{p}{p}<p>Ok.</p></div></div><div class=bottom>Copyright us</div>"
    assert H.main_text(layout) == f"T {words} {words} Ok."


def test_ratio_smoothing_and_clusters_by_hand():
    """Ratios, Gaussian weights and the cut of a page, computed line by line."""
    import math

    import numpy as np

    page = H.parsed(f"<body><p>{LONG}</p><p><a href=x>link</a></p><p>Short</p><p>{LONG}<b>x</b></p></body>")
    ratio = [0 if 2 * linked >= len(t) else (len(t) - linked) / max(tags, 1) for t, tags, linked, _ in page.lines]
    assert [x[1] for x in page.lines] == [1, 3, 1, 3] and ratio[1] == 0 and ratio[2] == 5
    weight = {d: math.exp(-0.5 * (d / H.SIGMA) ** 2) for d in range(-3, 4)}
    want = [sum(weight[j - i] * ratio[j] for j in range(4) if abs(j - i) <= 3) / sum(weight[j - i] for j in range(4) if abs(j - i) <= 3) for i in range(4)]
    assert np.allclose(H.smooth(np.array(ratio)), want)


def test_broken_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        H.main_text(page), V.plain_text(page), V.outlinks(page)
        return time.process_time() - began

    for piece in ("<a ", '<a href="', "<!--", "<![CDATA[", "<script", "<head><b>", "<head><noscript><b>", "<i><p><b></i>", "</div>", "<title", "<html ", "<head "):
        for end in ("", "> x </p>"):
            small, large = (seconds(piece * (n // len(piece)) + end) for n in (50_000, 200_000))
            assert large < 10 * small + 0.5, (piece, end, small, large)


def test_extract_on_odd_pages(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "t", 9), (1, "u", page, "t", 9), (2, None, None, None, None), (None, "u", "", "t", 1), (4, "u", f"<article><p>{'word ' * 200_000}</p></article>", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    found = sorted((str(r.page_id), r.n_chars) for r in got.collect())
    assert found == sorted([("1", len(LONG.strip()))] * 2 + [("2", 0), ("None", 0), ("4", 999_999)])
    assert H.extract(pages.where("false"), keep=["page_id"]).count() == 0


class _Plain(html.parser.HTMLParser):
    """The lines of a page by parser events, to hold plain_text against."""

    def __init__(self):
        super().__init__()
        self.out, self.quiet = [""], 0

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("head", "script", "style")
        if tag not in ("a", "b", "i"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.quiet -= tag in ("head", "script", "style")
        if tag not in ("a", "b", "i"):
            self.out.append("")

    def handle_data(self, data):
        if not self.quiet:
            self.out[-1] += data


def test_derivatives_of_the_driver_table(spark, sf):
    """Every record of every page against records built from parser events and the definition."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r.page_id, r.warc_type): r for r in V.op3_warc_derivatives(spark, sf).collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = pages.collect()
    assert len(got) == 2 * len(rows)
    for r in rows:
        plain = _Plain()
        plain.feed(r.html)
        text = "\n".join(x for x in (" ".join(t.split()) for t in plain.out) if x)
        meta, made = got[r.page_id, "metadata"], got[r.page_id, "conversion"]
        assert made.content == text and made.content_length == len(text.encode()) and made.block_digest == sha(text.encode())
        assert meta.refers_to == made.refers_to and meta.target_uri == made.target_uri == r.url and meta.refers_to.startswith("<urn:uuid:")
        assert made.source_payload_digest == meta.source_payload_digest == sha(r.html.encode()) and made.source_digest_matches is None
        fields = [x.split(": ", 1) for x in meta.content.split("\r\n")]
        assert fields[0] == ["http-status", "HTTP/1.1 200 OK"] and ["conversion", made.record_id] in fields and ["outlinks", str(r.html.count("<a "))] in fields
        assert ["payload-length", str(len(r.html.encode()))] in fields and ["payload-digest", sha(r.html.encode())] in fields
        assert ["http-header", f"Content-Length: {len(r.html.encode())}"] in fields


def test_derivatives_of_odd_rows(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    rows = [("<urn:1>", "http://i", "d", head + b"<p>x", None, "own", 1), ("<urn:1>", "http://i", "d", head + b"<p>x", None, "own", 1), (None, None, None, head + b"<p>word" * 100_000, None, None, None)]
    given = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary, payload_digest string, content string, n int")
    out = V.derivatives(given, keep=["content", "n", "record_id"])
    assert out.columns == ["target_uri", "date", "n", *[f.name for f in V.RECORD.fields]]
    got = out.collect()
    assert len(got) == 6 and sorted(r.content_length for r in got if r.warc_type == "conversion") == [1, 1, 499_999]
    assert len({r.record_id for r in got}) == 4
    assert V.derivatives(given.where("false")).count() == 0
    assert V.plain_text('<p>a<img alt="x < y">b</p>') == "ab" and V.outlinks('<a title="x<y" href=z>1</a><a name=t>2</a><abbr href=x>') == 1
