"""Alerts of agencies from stored pages: list page, links of items, detail page, as joins.

Pages are rows (url, html). An agency says where its list is, which links of it are items, where an
item's detail page lies and what its number is. Links are found with regular expressions over the
stored HTML; an item's date is that of the table row its link is in, else, where the agency has it
so, the first date of its detail page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import feed
from tidewatch.functions.urls import resolved
from tidewatch.lexicons import KOREAN, Profile
from tidewatch.operators.feed import classified

_TEXT = r"<[^>]*>"
_ROW = r"(?is)<tr\b[^>]*>(?:(?!<tr\b).)*?</tr\s*>"
_LINK = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, without its quotes; "" where it is absent."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(_plain(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])))


def _plain(text: Column) -> Column:
    """The common character references decoded, the ampersand's last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def visible(html: Column) -> Column:
    """The text of a piece of HTML: tags as blanks, character references decoded, white space squeezed."""
    return feed.clean_title(_plain(F.regexp_replace(html, _TEXT, " ")))


@dataclass(frozen=True)
class Agency:
    """Where an agency's items are: its list, the links that are items, their number and their page."""

    source: str
    prefix: str
    list_url: str
    #: Parts of which any must be whole in a link's href, or, with by_data, a class that the link must have.
    links: tuple[tuple[str, ...], ...]
    number: str = ""
    by_data: bool = False
    detail: str = ""
    date_in_detail: bool = False


# --- Fixed values: the addresses and marks of the agencies' boards --------------------------------
KISA = Agency(
    "KISA", "kisa", "https://spam.kisa.or.kr/spam/na/ntt/selectNttList.do?bbsId=1001&mi=1019", (("nttInfoBtn",),), by_data=True,
    detail="https://spam.kisa.or.kr/spam/na/ntt/selectNttInfo.do?bbsId=1001&mi=1019&nttSn={}",
)
POLICE = Agency("경찰청", "police", "https://www.police.go.kr/user/bbs/BD_selectBbsList.do?q_bbsCode=1002", (("BD_selectBbs.do",),), r"q_bbscttSn=([^&]+)")
FSS = Agency("금융감독원", "fss", "https://www.fss.or.kr/fss/bbs/B0000175/list.do?menuNo=200204", (("B0000175", "view.do"), ("/view.do",)), r"nttId=(\d+)", date_in_detail=True)
# --- End of fixed values --------------------------------------------------------------------------
AGENCIES = (KISA, POLICE, FSS)


def list_links(lists: DataFrame) -> DataFrame:
    """(list_url, at, attributes, title, row) for every link of list pages (url, html), in the order of the page.

    row is the text of the innermost table row that holds the link, or "". A link's place is the
    order in which its row, then it, is found; links outside rows come after those in rows.
    """
    rows = F.regexp_extract_all("html", F.lit(_ROW), F.lit(0))
    pieces = F.concat(rows, F.array(F.regexp_replace("html", _ROW, " ")))
    each = lists.select(F.col("url").alias("list_url"), F.size(rows).alias("n"), F.posexplode(pieces).alias("piece", "inner"))
    pair = F.arrays_zip(F.regexp_extract_all("inner", F.lit(_LINK), F.lit(1)).alias("attributes"), F.regexp_extract_all("inner", F.lit(_LINK), F.lit(2)).alias("body"))
    found = each.select("list_url", "piece", F.when(F.col("piece") < F.col("n"), visible(F.col("inner"))).otherwise("").alias("row"), F.posexplode(pair).alias("k", "l"))
    return found.select("list_url", F.struct("piece", "k").alias("at"), F.col("l.attributes").alias("attributes"), visible(F.col("l.body")).alias("title"), "row")


def items(pages: DataFrame, agency: Agency, lists: DataFrame | None = None, limit: int | None = None, profile: Profile = KOREAN) -> DataFrame:
    """(id, source, title, published_at, url, category, keywords, summary): the alerts of an agency's stored list pages.

    lists, a table with a column url, names its list pages, by default the one. Items whose detail
    page is the same count once, the first of the page. With a limit the first so many of all lists
    by list and place stay. A detail page that is not stored leaves the date empty.
    """
    wanted = pages.where(F.col("url") == agency.list_url) if lists is None else pages.join(lists.select("url").distinct(), "url", "left_semi")
    links = list_links(wanted).withColumns({"href": attribute(F.col("attributes"), "href"), "data": attribute(F.col("attributes"), "data-id")})
    if agency.by_data:
        names = F.split(attribute(F.col("attributes"), "class"), r"\s+")
        links = links.where(reduce(lambda a, b: a & b, [F.array_contains(names, part) for part in agency.links[0]]) & (F.col("data") != ""))
        before, after = agency.detail.split("{}")
        links = links.withColumns({"url": F.concat(F.lit(before), "data", F.lit(after)), "number": F.col("data")})
    else:
        fits = [reduce(lambda a, b: a & b, [F.col("href").contains(part) for part in parts]) for parts in agency.links]
        links = links.where(reduce(lambda a, b: a | b, fits)).withColumn("url", resolved(F.col("list_url"), F.col("href")))
        found = F.regexp_extract("url", agency.number, 1)
        links = links.withColumn("number", F.when(found != "", found).otherwise(F.sha1(F.col("url").cast("binary"))))
    links = links.where(F.col("title") != "").where(feed.is_alert(F.col("title"), profile))
    once = links.groupBy("url").agg(F.min_by(F.struct("list_url", "at", "title", "row", "number"), F.struct("list_url", "at")).alias("i")).select("url", "i.*")
    if limit is not None:
        once = once.orderBy("list_url", "at").limit(limit)
    once = once.withColumn("published_at", feed.iso_date(F.col("row")))
    if agency.date_in_detail:
        # Of repeated captures of a page the smallest content hash counts.
        undated = once.where("published_at = ''").select(F.col("url").alias("_wanted"))
        seen = pages.select(F.col("url").alias("_u"), F.col("html").alias("_h")).join(undated, F.col("_u") == F.col("_wanted"), "left_semi")
        seen = seen.groupBy("_u").agg(F.min_by("_h", F.xxhash64("_h")).alias("_h")).select("_u", feed.iso_date(visible(F.col("_h"))).alias("_date"))
        once = once.join(seen, F.col("url") == F.col("_u"), "left").withColumn("published_at", F.when(F.col("published_at") != "", F.col("published_at")).otherwise(F.coalesce("_date", F.lit(""))))
    rows = once.select(F.concat(F.lit(f"{agency.prefix}-"), "number").alias("id"), F.lit(agency.source).alias("source"), "title", "published_at", "url")
    return classified(rows, profile)


def details(pages: DataFrame, found: DataFrame, marks: tuple[str, ...], least: int = 40, most: int = 220) -> DataFrame:
    """(url, body) of items' stored detail pages: the text of the first element of a class of marks, in their order, that is long enough.

    "article" stands for the element. Text beyond most characters is cut and marked; a page without
    such an element has a null body.
    """
    def body(mark: str) -> Column:
        start = r"(?is)<article\b[^>]*>(.*?)</article\s*>" if mark == "article" else rf"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*\b{mark}\b[^"']*["'][^>]*>(.*?)</\1\s*>"""
        return visible(F.regexp_extract("html", start, 1 if mark == "article" else 2))

    texts = F.array(*[body(m) for m in marks])
    first = F.get(F.filter(texts, lambda t: F.length(t) >= least), 0)
    cut = F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)
    once = pages.join(found.select("url").distinct(), "url", "left_semi")
    ranked = once.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy(F.xxhash64("html")))).where("_n = 1")
    return ranked.select("url", cut.alias("body"))
