"""Readers with explicit schemas: reports, lists, datasets, feeds and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import feed
from tidewatch.operators.relational import labelled
from tidewatch.sources.versions import Versions

REPORT = "id long, text string, sender string, urls array<string>, domains array<string>, tokens array<string>, source string, case_key string, status string, created_at timestamp"
FEED = "id string, source string, title string, published_at string, category string, summary string, keywords array<string>, url string"


def reports(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Report rows; columns that older files lack are null. source is pushed down to the files."""
    rows = spark.read.schema(REPORT).option("mergeSchema", "true").parquet(path)
    return rows if source is None else rows.where(F.col("source") == source)


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A CSV in UTF-8, or in CP949 (which holds EUC-KR) if a line is no UTF-8. A byte-order mark is dropped.

    Spark reads bytes that aren't text as replacement characters instead of failing, so lines are
    looked at until one such is found. CP949 is read byte by letter, as none of its bytes stands
    for a comma, a quote or a line end within a letter, and its columns are decoded in Arrow batches.
    """
    lines = spark.read.text(path)
    utf8 = not lines.where(F.col("value").contains("\ufffd") | ~F.is_valid_utf8("value")).limit(1).count()
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", True)
    if utf8:
        rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
        return rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])

    @F.pandas_udf("string")
    def decoded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else b.decode("cp949", "replace"))

    rows = reader.option("encoding", "ISO-8859-1").csv(path)
    names = [c.encode("latin-1").decode("cp949", "replace") for c in rows.columns]
    rows = rows.select(*[decoded(F.encode(F.col(f"`{c}`"), "ISO-8859-1")).alias(n) for c, n in zip(rows.columns, names, strict=True)])
    if schema is None:
        return rows
    wanted = spark.createDataFrame([], schema).schema.fields
    return rows.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, wanted, strict=True)])


def ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV of rank and domain."""
    return spark.read.schema("rank int, raw_domain string").option("header", "false").csv(path)


def seed_messages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of messages (text, sender) without blank texts."""
    rows = spark.read.schema("text string, sender string").option("multiLine", "true").json(path)
    return rows.where(F.trim("text") != "")


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a line file, lower-case and distinct; lines with # and blank ones are passed over."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.lower(line).alias("domain")).distinct()


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Cached alerts: the current version of a feed, or a file with one to a line, a list, or an object with items.

    A file that is no JSON gives none.
    """
    current = Versions(spark, path, "json").folder()
    path = path if current is None else f"{path}/{current}"
    reader = spark.read.schema(f"{FEED}, items array<struct<{FEED}>>").option("mode", "DROPMALFORMED")
    rows = reader.json(path)
    if rows.where("id IS NOT NULL OR url IS NOT NULL OR title IS NOT NULL OR items IS NOT NULL").isEmpty():
        rows = reader.option("multiLine", "true").json(path)  # a list or object over several lines
    flat = rows.where("items IS NULL").drop("items")
    return flat.unionByName(rows.where("items IS NOT NULL").select(F.explode("items").alias("i")).select("i.*")).where("id IS NOT NULL OR url IS NOT NULL OR title IS NOT NULL")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def dataset(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """A labelled CSV: rows with a text and a label, which must be 0 or 1."""
    return labelled(csv(spark, path), text, label)


def alerts_from_pages(pages: DataFrame, source: str = "KISA", url: str = "url", html: str = "html", limit: int | None = None) -> DataFrame:
    """Alert items from stored pages: heading or title, first date in the page, category, keywords, summary."""
    inner = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    heading = F.when(inner("h1") != "", inner("h1")).otherwise(inner("title"))
    title = feed.clean_title(F.regexp_replace(F.regexp_replace(heading, r"<[^>]*>", " "), "&amp;", "&"))
    rows = pages.select(F.sha1(F.col(url).cast("binary")).alias("id"), F.lit(source).alias("source"), title.alias("title"), feed.iso_date(F.col(html)).alias("published_at"), F.col(url).alias("url"))
    rows = rows.where("title <> ''")
    return rows if limit is None else rows.orderBy(F.desc("published_at"), "id").limit(limit)
