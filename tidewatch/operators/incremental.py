"""Clusters that follow new reports without being made anew.

A state folder holds what batches added, each under its number: the members (id, root), the link keys
(key, root) that no earlier batch had, and the merges (old, new) of roots. A batch explodes its own
reports into link keys, looks up which of them are known, finds the components of its reports and of
the roots they touch, and appends: members under their root, new keys, and a merge for every touched
root that is no longer one. No earlier row is rewritten, so a batch writes and shuffles in proportion
to its own reports; the state is only scanned, against a broadcast of the batch's keys while they are
few. A batch that is run again replaces what it wrote, and reads what came before it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.components import connected_components, stored
from tidewatch.operators.relational import numbered

#: Keys or roots, counted, up to which a batch's side is broadcast against the state.
FEW = 500_000
TABLES = {"members": "id long, root long", "keys": "key string, root long", "merges": "old long, new long"}


def link_keys(rows: DataFrame) -> DataFrame:
    """(id, key): what links a prepared report to others: registered domains, the sender, and pairs of strong tokens."""
    words = F.array_sort(F.array_distinct("strong"))
    pairs = F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.concat(F.lit("p:"), F.length(x).cast("string"), F.lit(":"), x, y))))
    domains = F.transform(F.filter("regs", lambda r: r != ""), lambda r: F.concat(F.lit("d:"), r))
    sender = F.when(F.coalesce("sender", F.lit("")) != "", F.array(F.concat(F.lit("s:"), "sender"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return rows.select(F.col("id").cast("long").alias("id"), F.explode(F.concat(F.coalesce(domains, none), sender, F.coalesce(pairs, none))).alias("key")).distinct()


def _before(spark: SparkSession, state: str, name: str, number: int | None) -> DataFrame:
    """The rows of a state table that batches before a number added; all without a number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{state}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], TABLES[name])
    rows = spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{state}/{name}")
    return (rows if number is None else rows.where(F.col("batch") < number)).drop("batch")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def current_roots(roots: DataFrame, merges: DataFrame) -> DataFrame:
    """(root, now) for distinct roots: where merges have taken them, followed to the end.

    Each round follows one merge; a root that merged in k batches after another takes k rounds.
    """
    at = stored(roots.select("root", F.col("root").alias("now")), "roots")
    while True:
        moved = at.join(merges, F.col("now") == F.col("old"), "left")
        moved = stored(moved.select("root", F.coalesce("new", "now").alias("now"), F.col("new").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("root", "now")
        at = moved.select("root", "now")


def add(state: str, rows: DataFrame, number: int) -> None:
    """Add a batch of prepared reports, with ids that no earlier batch had, as the batch of a number."""
    spark = rows.sparkSession
    mine = stored(link_keys(rows), "batch-keys")
    wanted = stored(mine.groupBy("key").agg(F.min("id").alias("low")), "batch-wanted")
    n = wanted.count()
    known = stored(_before(spark, state, "keys", number).join(_small(wanted.select("key"), n), "key"), "batch-known")
    touched = stored(current_roots(known.select("root").distinct(), _before(spark, state, "merges", number)), "batch-touched")
    owned = known.join(touched, "root").select("key", "now")
    links = mine.join(wanted, "key").where("low < id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(wanted.join(owned, "key").select(F.col("now").alias("a"), F.col("low").alias("b"))).distinct()
    labels = stored(connected_components(links, "a", "b"), "batch-labels")
    own = rows.select(F.col("id").cast("long").alias("id")).distinct()
    members = own.join(labels, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("root"))
    members = stored(members, "batch-members")
    merges = touched.select(F.col("now").alias("vertex")).distinct().join(labels, "vertex").where("vertex <> component").select(F.col("vertex").alias("old"), F.col("component").alias("new"))
    fresh = wanted.join(known.select("key"), "key", "left_anti").join(members, F.col("low") == F.col("id")).select("key", "root")
    for name, df in (("keys", fresh), ("merges", merges), ("members", members)):
        df.write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")


def labels(spark: SparkSession, state: str) -> DataFrame:
    """(id, root): the smallest report that each one is linked to over all batches."""
    members, merges = _before(spark, state, "members", None), _before(spark, state, "merges", None)
    moved = connected_components(merges, "old", "new")  # a merge's new root is the smaller one
    return members.join(moved, F.col("root") == F.col("vertex"), "left").select("id", F.coalesce("component", "root").alias("root"))


def clusters(spark: SparkSession, state: str) -> DataFrame:
    """(id, root, cluster) as graph.clusters gives it for all reports at once."""
    rooted = stored(labels(spark, state), "rooted")
    return stored(rooted.join(numbered(rooted.select("root").distinct(), ["root"], "cluster"), "root").select("root", "id", "cluster"), "clusters")


def compact(state: str, spark: SparkSession, number: int) -> None:
    """Fold all batches up to a number into it, with members and keys under their present roots and no merges left.

    For a time when no batch runs: it costs what the state holds, and later batches follow no old merges.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    moved = stored(connected_components(_before(spark, state, "merges", number + 1), "old", "new"), "moved")

    def now(name: str, key: str) -> DataFrame:
        rows = _before(spark, state, name, number + 1)
        return stored(rows.join(moved, F.col("root") == F.col("vertex"), "left").select(key, F.coalesce("component", "root").alias("root")), name)

    folded = {"keys": now("keys", "key"), "members": now("members", "id"), "merges": spark.createDataFrame([], TABLES["merges"])}
    files = hadoop.Path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, df in folded.items():
        df.write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
        for f in files.listStatus(hadoop.Path(f"{state}/{name}")):
            batch = f.getPath().getName().removeprefix("batch=")
            if batch.isdigit() and int(batch) < number:
                files.delete(f.getPath(), True)

