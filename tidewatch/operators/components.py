"""Connected components over an edge table, as a DataFrame loop with written tables between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, a laptop) a temporary one is set once."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


#: Folders that stored has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str = "table", partition_by: list[str] | None = None, schema: StructType | None = None, group_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet under the shared folder and read it back, under another schema of the same columns if given. drop_stored deletes what was written.

    group_bytes bounds a row group, and so what a task holds of it when it writes or reads wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.mode("errorifexists")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, and say how many; for when the results that read them are written."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


#: Edges, counted, beyond which no side is broadcast, whatever Spark makes of the size of its files.
MANY_EDGES = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex that occurs in an edge with the smallest vertex it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is a grouped
    minimum, which combines before the shuffle, and one equi-join, so a vertex with very many
    edges costs no more than its edges. Edges with a null end are ignored; self loops label
    their vertex with itself. Returns columns (vertex, component).
    """
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    pairs = stored(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    vertices = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).distinct()
    current = pairs.where("u <> v")
    many = pairs.count() > MANY_EDGES
    joined = lambda df: df.hint("merge") if many else df
    seen = None
    for _ in range(max_rounds):
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(joined(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joined(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        current = stored(small.where("u <> v").distinct(), "edges")
        sign = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = current.groupBy("u").agg(F.min("v").alias("m"))
    return vertices.join(joined(labels), vertices["vertex"] == labels["u"], "left").select(
        "vertex", F.coalesce("m", "vertex").alias("component")
    )
