"""Metadata and plain-text conversion records derived from WARC response records.

A response's derivatives refer to it by its record identifier, repeat its target and date, and keep
its HTTP status and headers and its digests, which are computed again and compared. Records are
written and read by Spark's text source: a WARC record ends with two line ends, so files are rows
whose separator these are, and reading splits them at the version line of the next record.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, with_arrow_columns

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: The date of records made from pages, which have none.
CRAWLED = "2024-01-01T00:00:00Z"

#: What a tag holds: no "<" or ">" but "<" in quotes. Scans stop at the next tag, so broken pages take linear time.
_IN = r"""(?>[^<>"']+|"[^">]*"|'[^'>]*'|["'])*+"""
#: A head goes up to its end tag or, without one, up to the first thing that a head can't hold.
_HEAD = (
    rf"<head(?=[\s/>]){_IN}>(?>\s+|<!--.*?(?:-->|\Z)|<!(?!--){_IN}>|<(script|style)\b{_IN}>.*?(?:</\1\s*>|(?=</head\b)|\Z)"
    rf"|<(noscript|noframes|template|title)\b{_IN}>.*?(?:</\2\s*>|(?=</head\b|<body\b)|\Z)|</?(?:base|basefont|bgsound|link|meta)\b{_IN}>)*+(?:</head\s*>)?"
)
_DROPPED = re.compile(rf"{_HEAD}|<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b{_IN}>.*?(?:</\3\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|"
    rf"section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b{_IN}>",
    re.I,
)
_TAG = re.compile(rf"<[!/?a-zA-Z]{_IN}>")
_TITLE = re.compile(rf"<title\b{_IN}>([^<]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HTML = re.compile(rf"<html\b({_IN})>", re.I)
_LINK = re.compile(rf"<a\b({_IN})>", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("source_payload_digest", T.StringType()),
        T.StructField("source_digest_matches", T.BooleanType()),
        T.StructField("content", T.StringType()),
    ]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that depends on the parts only, so a rerun links the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def _one_line(text: str) -> str:
    return " ".join(text.split())


def plain_text(page: str) -> str:
    """The text of a page, a line for each block; scripts, styles, comments and the head are left out.

    Line ends of the page's source are white space, as in browsers.
    """
    lines = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub("", page.replace("\n", " ")))).split("\n")
    return "\n".join(x for x in (_one_line(html.unescape(line)) for line in lines) if x)


def outlinks(page: str) -> int:
    """The number of a elements with a target."""
    return sum(1 for attributes in _LINK.findall(page) if _HREF.search(attributes))


def derive(response_id: str | None, uri: str | None, block: bytes | None, given: str | None) -> list[tuple]:
    """The metadata record and, for text, the conversion record of one response."""
    response_id, uri = response_id or "", uri or ""
    head, _, body = (block or b"").partition(END.encode())
    status, *headers = head.decode("latin-1").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in headers)}
    kind = fields.get("content-type", "")
    actual = digest(body)
    matches = given == actual if given else None
    out, links = [], {"title": "", "language": "", "outlinks": "0"}
    if kind.startswith("text/") or "html" in kind or not kind:
        charset = _CHARSET.search(kind) or _CHARSET.search(body[:1024].decode("latin-1"))
        try:
            page = body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        if "html" in kind or not kind:
            links["title"] = _one_line(html.unescape(m[1])) if (m := _TITLE.search(page)) else ""
            links["language"] = m[1] if (t := _HTML.search(page)) and (m := _LANG.search(t[1])) else ""
            links["outlinks"] = str(outlinks(page))
            page = plain_text(page)
        content = page.encode("utf-8", "replace")
        out.append((record_id(response_id, uri, "conversion"), "conversion", response_id, "text/plain; charset=utf-8", len(content), digest(content), given or actual, matches, content.decode()))
    lines = [("http-status", status), *(("http-header", _one_line(h)) for h in headers), *links.items(), ("payload-digest", given or actual), ("payload-length", str(len(body)))]
    lines += [("conversion", r[0]) for r in out]
    content = "\r\n".join(f"{k}: {v}" for k, v in lines if v).encode()
    out.insert(0, (record_id(response_id, uri, "metadata"), "metadata", response_id, "application/warc-fields", len(content), digest(content), given or actual, matches, content.decode()))
    return out


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per derived record, with the kept columns of its response.

    responses has record_id, target_uri, date, block (bytes: HTTP head and body) and payload_digest.
    A null block is an empty one: its metadata record says so and its conversion is empty; a null
    digest is computed and source_digest_matches is null. Content that isn't text gets metadata
    only. Repeated responses get repeated records with the same identifiers. Kept columns that are
    named like a column of a record are left out, for the record's own.
    """

    def compute(batch: pa.RecordBatch) -> list:
        names = [f.name for f in RECORD.fields]
        return [[[dict(zip(names, r, strict=True)) for r in derive(*row)] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]]

    kept = [c for c in ("target_uri", "date") if c not in (keep or [])] + [c for c in keep or [] if c not in RECORD.fieldNames()]
    inputs = {"id": F.col("record_id"), "uri": F.col("target_uri"), "block": F.col("block"), "digest": F.col("payload_digest")}
    rows = with_arrow_columns(responses, inputs, [T.StructField("records of a response", T.ArrayType(RECORD))], compute, kept)
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.explode("records of a response").alias("r")).select(*[F.col(f"`{c}`") for c in kept], "r.*")


def responses_from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = CRAWLED) -> DataFrame:
    """Response records for stored pages: the page as an HTTP 200 answer in UTF-8, under the key's identifier."""
    body = F.coalesce(F.col(f"`{page}`"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit(END))
    name = F.md5(F.concat_ws(" ", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{url}`"), F.lit(""))))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col(f"`{key}`").alias(key),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(f"`{url}`").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head.cast("binary"), body).alias("block"),
        F.lit(None).cast("string").alias("payload_digest"),
    )


def as_text(records: DataFrame) -> Column:
    """A derived record as WARC text without its final two line ends."""
    refers = F.when(F.col("refers_to") != "", F.concat(F.lit("WARC-Refers-To: "), "refers_to", F.lit("\r\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\n"), refers, F.lit("WARC-Target-URI: "), F.coalesce("target_uri", F.lit("")),
        F.lit("\r\nWARC-Date: "), F.coalesce("date", F.lit("")), F.lit("\r\nWARC-Block-Digest: "), "block_digest", F.lit("\r\nWARC-Source-Payload-Digest: "), "source_payload_digest",
        F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit(END),
    )
    return F.concat(head, "content")


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files, one for each partition."""
    records.select(as_text(records).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers (a map with lower-case names) and block.

    Uncompressed files are read in splits. whole is false where the block's length isn't the one
    declared: in a record whose block holds the text that separates records, or ends with line
    ends of its own, which a split reader may take for part of that text.
    """
    text = spark.read.option("lineSep", f"{END}{VERSION}\r\n").text(path).where("value <> ''")
    record = F.regexp_replace("value", rf"^{VERSION}\r\n", "")
    at = F.instr(record, END)
    rows = text.select(F.substring(record, F.lit(1), at - 1).alias("head"), F.substring(record, at + len(END), F.length(record)).alias("rest"))
    pairs = F.transform(F.split("head", "\r\n"), lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    rows = rows.withColumn("headers", F.map_from_entries(F.filter(pairs, lambda p: p["k"] != "")))
    size = F.col("headers")["content-length"].cast("long")
    # The last record of a file keeps its final line ends.
    block = F.when(F.octet_length("rest") == size + len(END), F.regexp_replace("rest", r"\r\n\r\n\z", "")).otherwise(F.col("rest"))
    return rows.withColumn("block", block).select("headers", "block", (F.octet_length("block") == size).alias("whole"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion records of every page, stored as the answer to a request for it."""
    return derivatives(responses_from_pages(table(spark, sf_dir, "pages")), keep=["page_id"])
