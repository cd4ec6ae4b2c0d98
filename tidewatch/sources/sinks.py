"""Writers: datasets, feeds, runs, block lists and fingerprints of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.versions import Versions


def csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header, after a byte-order mark unless that is not wanted; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]) if mark else out
    out.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def feed(df: DataFrame, path: str) -> bool:
    """Replace the cached feed by a new version unless there is nothing to write; says whether it did.

    df may read the feed it replaces. The version before stays, as readers may be at it; older ones go.
    """
    if df.isEmpty():
        return False
    store = Versions(df.sparkSession, path, "json")
    store.publish(df)
    store.expire()
    return True


def run_result(spark: SparkSession, path: str, version: str, decision: str, **numbers: float) -> None:
    """Append one run to the table of runs."""
    rows = spark.createDataFrame([(version, decision, {k: float(v) for k, v in numbers.items()})], "version string, decision string, numbers map<string,double>")
    rows.write.mode("append").parquet(path)


def block_list(df: DataFrame, path: str, domain: str = "domain", heading: str = "blocked domains") -> None:
    """Sorted distinct domains as lines, after a comment."""
    lines = df.select(F.col(domain).alias("value")).where("value NOT LIKE '%@%'").distinct()
    head = df.sparkSession.createDataFrame([(f"# {heading}", 0)], "value string, o int")
    head.unionByName(lines.withColumn("o", F.lit(1))).orderBy("o", "value").select("value").write.mode("overwrite").text(path)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, sha256) of the rows' contents whatever their order or partitions.

    Rows are hashed one by one; the digests of each of 4096 groups by their leading digits are sorted
    and hashed, and so are those of the groups, so no task holds the digests of all rows.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    each = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("g"))
    groups = each.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))
