"""The driver's tables as the entities that the operators take."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import rounded
from tidewatch.functions.urls import host_of
from tidewatch.lexicons import ENGLISH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ipv4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs made of the dotted quads that documents hold."""
    hits = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(hits).alias("ip")).distinct().select(F.concat(F.lit("http://"), "ip", F.lit("/login")).alias("url"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs and those of addresses in documents, each once."""
    return table(spark, sf_dir, "pages").select("url").union(ipv4_urls(spark, sf_dir)).distinct()


def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as user reports of one host each."""
    host = host_of(F.col("url"))
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit(None).cast("string").alias("sender"), F.array("url").alias("urls"), F.array(host).alias("domains"), empty.alias("tokens"),
        F.lit("user").alias("source"), F.lit("pending").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports: the user and event type as the case, the smallest event type as seeds."""
    e = table(spark, sf_dir, "events")
    case = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_type"), F.to_date("ts").cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.col("props").alias("text"), F.col("user_id").cast("string").alias("sender"), case.alias("case_key"),
        F.when((F.col("event_id") % 97) == 0, "seed").otherwise("user").alias("source"), F.col("ts").alias("created_at"),
    )


def day_reports(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Events as reports of a host under one domain for each event type and day; every event, or one in so many, names its user as the sender."""
    e = table(spark, sf_dir, "events")
    domain = F.concat_ws("-", "event_type", F.to_date("ts").cast("string"))
    host = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"), F.lit("."), domain, F.lit(".test"))
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % every == 0, F.col("user_id").cast("string")).alias("sender"), F.array(host).alias("domains"),
        F.array().cast("array<string>").alias("tokens"), F.col("ts").alias("created_at"),
    )


#: Words that link turns of conversations; none is cut and none is left out.
CHAT = replace(ENGLISH, particles=(), stopwords=(), strong_tokens=("sch", "thre", "zu", "ein", "para", "con", "avec", "dans", "nicht", "pas"))


def turn_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reports: users' turns name their sender, first turns a host, and all have their words as tokens."""
    c = table(spark, sf_dir, "conversations")
    host = F.concat(F.lit("h"), (F.col("conv_id") % 3).cast("string"), F.lit(".s"), F.floor(F.col("conv_id") / 12).cast("string"), F.lit(".com"))
    none = F.array().cast("array<string>")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "user", F.concat(F.lit("n"), F.col("conv_id").cast("string"))).alias("sender"),
        F.when(F.col("turn") == 0, F.array(host)).otherwise(none).alias("domains"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"),
        F.lit("user").alias("source"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("conv_id") * 37 % 480).cast("int"), F.col("turn").cast("int"))).alias("created_at"),
    )


def distinct_share(text: Column) -> Column:
    """Distinct words over words, 0 without words, to four places."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.when(F.size(words) > 0, rounded(F.size(F.array_distinct(words)) / F.size(words), 4)).otherwise(0.0)


def predictions(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    """Labelled documents with a score (distinct words over words), a prediction and group columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", distinct_share(F.col("text")).alias("score"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "score", F.col("quality").alias("label"), "toxic")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
