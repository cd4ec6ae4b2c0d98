"""Synthetic messages from slot templates, each row a function of the seed and its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(values: list[str], *parts: Column) -> Column:
    """One of the values by the first 32 bits of the MD5 of the parts, which any SQL engine can follow."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def fill(template: Column, slots: dict[str, list[str]], *parts: Column) -> Column:
    """The template with each {slot} replaced by a value that the parts choose."""
    for name, values in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), _pick(values, *parts, F.lit(name)))
    return template


def from_templates(spark: SparkSession, templates: list[tuple[str, str]], slots: dict[str, list[str]], each: int, label: int, seed: int = 42) -> DataFrame:
    """each rows of every (kind, template): id, text, label, is_synthetic, synthetic_type."""
    rows = spark.range(len(templates) * each)
    at = (F.col("id") % len(templates)).cast("int")
    chosen = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, t in templates]), at + 1)
    rows = rows.withColumn("_t", chosen)
    return rows.select("id", fill(F.col("_t.t"), slots, F.lit(seed), F.col("id")).alias("text"), F.lit(label).alias("label"), F.lit(True).alias("is_synthetic"), F.col("_t.kind").alias("synthetic_type"))


def pairs(spark: SparkSession, specs: list[tuple[str, str, str, str]], slots: dict[str, list[str]], each: int, seed: int = 42) -> DataFrame:
    """A normal and a phishing row with the same slots for each number of every (scenario, subtype, normal, phishing).

    The number is a slot too ({n}), which keeps the rows of a subtype apart.
    """
    chosen = F.element_at(
        F.array(*[F.struct(F.lit(a).alias("scenario"), F.lit(b).alias("subtype"), F.array(F.lit(x), F.lit(y)).alias("t")) for a, b, x, y in specs]), (F.col("id") % len(specs)).cast("int") + 1
    )
    rows = spark.range(len(specs) * each).withColumn("s", chosen).select(F.col("id").alias("pair_id"), "s.scenario", "s.subtype", F.posexplode("s.t").alias("label", "t"))
    text = F.replace(fill(F.col("t"), slots, F.lit(seed), F.col("pair_id")), F.lit("{n}"), F.col("pair_id").cast("string"))
    return rows.select((F.col("pair_id") * 2 + F.col("label")).alias("id"), "pair_id", text.alias("text"), F.col("label").cast("int").alias("label"), "scenario", "subtype")


def check_pairs(df: DataFrame) -> None:
    """Raise an error unless ids and texts are unique and each pair has one row of either label."""
    bad = df.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("l")).where("n <> 2 OR l <> 2").limit(1).count()
    counts = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("i"), F.count_distinct("text").alias("t")).first()
    if bad or counts.n != counts.i or counts.n != counts.t:
        raise ValueError("rows aren't unique, or a pair isn't one of each label")


def mined(df: DataFrame, text: str, pattern: str, limit: int = 500) -> DataFrame:
    """Distinct matches of a pattern, most frequent first, to fill slots with."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("value"))
    return found.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)
