"""Registered domains by a table of public suffix rules.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``, any label before ck) or an exception to a
wildcard (``!www.ck``). Of the rules that fit a host an exception counts, else the longest; where
none fits, the last label is the suffix. The registered domain is the suffix and the label before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, counted, up to which they are broadcast.
FEW = 500_000
PLAIN, WILD, EXCEPT = 0, 1, 2


def rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, kind, size) from the lines of a suffix list; comments (//) and blank lines are passed over, and rules are lower-cased."""
    rule = F.lower(F.regexp_extract(F.trim(column), r"^(\S*)", 1))
    kept = lines.select(rule.alias("r")).where("r <> '' AND NOT startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), EXCEPT).when(F.col("r").startswith("*."), WILD).otherwise(PLAIN)
    name = F.regexp_replace("r", r"^(?:!|\*\.)", "")
    return kept.select(name.alias("name"), kind.alias("kind"), F.size(F.split(name, r"\.")).alias("size")).where("name <> '' AND name <> '*'").distinct()


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def registered(hosts: DataFrame, known: DataFrame, host: str = "host") -> DataFrame:
    """(host, suffix, domain) for each distinct host, of any case; a host that is a suffix, or one label, keeps its last two labels.

    Hosts meet the rules under their own endings, no more of them than the longest rule has labels.
    A null or blank host has an empty suffix and domain.
    """
    longest = (known.agg(F.max("size")).first()[0] or 0) + 1
    few = known.limit(FEW + 1).count() <= FEW
    clean = F.regexp_replace(F.lower(F.trim(F.coalesce("host", F.lit("")))), r"\.+$", "")
    each = hosts.select(F.col(host).alias("host")).distinct().select("host", F.split(clean, r"\.").alias("labels"))
    n = F.size("labels")
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(longest))), lambda k: _last(F.col("labels"), k))
    met = each.select("host", "labels", F.explode(ends).alias("name")).join(F.broadcast(known) if few else known, "name")
    sizes = met.groupBy(F.col("host").alias("_h")).agg(
        F.max(F.when(F.col("kind") == EXCEPT, F.col("size") - 1)).alias("exception"),
        F.max(F.when(F.col("kind") == PLAIN, F.col("size")).when((F.col("kind") == WILD) & (n > F.col("size")), F.col("size") + 1)).alias("longest"),
    )
    k = F.coalesce("exception", "longest", F.lit(1))
    out = each.join(sizes, each["host"].eqNullSafe(sizes["_h"]), "left").withColumn("_k", k)
    domain = F.when(n > F.col("_k"), _last(F.col("labels"), F.col("_k") + 1)).otherwise(_last(F.col("labels"), F.lit(2)))
    return out.select("host", _last(F.col("labels"), F.col("_k")).alias("suffix"), domain.alias("domain"))


def with_registered(df: DataFrame, known: DataFrame, key: str, hosts: str, name: str = "regs") -> DataFrame:
    """df, whose key is unique, with the distinct registered domains of an array of hosts, sorted."""
    each = df.select(F.col(key).alias("_k"), F.explode(hosts).alias("_host"))
    found = registered(each, known, "_host").withColumnRenamed("host", "_host")
    regs = each.join(found, "_host").groupBy("_k").agg(F.array_sort(F.collect_set("domain")).alias(name))
    out = df.join(regs, df[key] == regs["_k"], "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
