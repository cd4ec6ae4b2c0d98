"""Near-duplicate documents by SimHash, compared through pivot distance tables.

Fingerprints within ``radius`` differing bits are linked. Two fingerprints of 64 bits in seven
blocks that differ in at most four bits agree on at least three blocks, so every linked pair meets
under one of the 35 block triples. The fingerprints that meet have a table of Hamming distances to
fixed reference fingerprints (pivots): by the triangle inequality a linked pair differs by at most
``radius`` in every coordinate. One coordinate, cut into cells, is part of the key that joins pairs;
the largest difference over all coordinates discards pairs, those with a hub as well; the survivors
are verified.

A dense group of copies never becomes all its pairs. Equal fingerprints are one row. Members of a
key are first compared with the smallest and the largest fingerprint of that key only; the
components of those links are found, and pairs are then formed only between different components
that still meet under some key. No link between components is lost by this.

What grows with the corpus is joined by merge: Spark sizes a table by its files, and so takes the 35
rows that a fingerprint explodes into for one, and would broadcast millions of rows as few.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tidewatch.llm.common import table, with_arrow_columns
from tidewatch.operators.components import connected_components, stored

SHINGLE = 4
RADIUS = 4
PIVOTS = 16
#: A root that holds over one in this many rows is joined apart from the others; fewer roots than this can.
LARGE = 1000
#: Widths of the seven blocks, from the lowest bit.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)


def _masks(agree: int) -> list[int]:
    starts = np.cumsum((0, *BLOCKS))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts, strict=False)]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivots(n: int) -> list[int]:
    """Reference fingerprints: hashes of their numbers, the same on every run."""
    found = [xxh64_intdigest(f"pivot {i}", 42) for i in range(n)]
    return [p - (1 << 64) if p >> 63 else p for p in found]


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text: lower-case A-Z, words joined by one space."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - size] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[k : k + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of every whole text as a long."""

    def compute(batch: pa.RecordBatch) -> list:
        found = [fingerprint(shingle_hashes(x.as_py())) for x in batch.column(0)]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    return with_arrow_columns(docs, {"text": F.col(f"`{text}`").cast("binary")}, [T.StructField(name, T.LongType())], compute, keep)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _coordinates(fp: Column, n_pivots: int) -> Column:
    """The row of the pivot table: the Hamming distance of a fingerprint to every pivot."""
    return F.array(*[_differ(fp, F.lit(p)).cast("byte") for p in _pivots(n_pivots)])


def _linked(a: Column, b: Column, d: Column, d2: Column, radius: int, n_pivots: int) -> Column:
    """Pairs that no coordinate discards, verified by their bits."""
    return (F.greatest(*[F.abs(d[i] - d2[i]) for i in range(n_pivots)]) <= radius) & (_differ(a, b) <= radius)


def _with_root(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with the columns of their root's one row in values, null where it has none.

    Rows of a root that holds more than one in LARGE of them stay where they are and the root's
    values, fewer than LARGE rows, are broadcast; so no task gets all of a large component. The
    other rows are joined by root. Both tables must be stored ones: they are read several times.
    """
    total = rows.count()
    large = stored(rows.groupBy("root").count().where(F.col("count") * LARGE > total).select("root"), "large")
    ahead = F.broadcast(values.join(F.broadcast(large), "root", "left_semi"))
    few = F.broadcast(large)
    return rows.join(few, "root", "left_semi").join(ahead, "root", "left").unionByName(
        rows.join(few, "root", "left_anti").join(values.join(few, "root", "left_anti").hint("merge"), "root", "left")
    )


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS) -> DataFrame:
    """(fp, root) for a table with one row per fingerprint; root is the smallest fingerprint reachable.

    radius may be 0 to 4. A fingerprint without a link is its own root.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    masks = _masks(len(BLOCKS) - radius)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in enumerate(masks)])).alias("k"),
    ).select("fp", "k.t", "k.m")
    crowded = keyed.groupBy("t", "m").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    met = keyed.join(crowded.hint("merge"), ["t", "m"]).withColumn("d", _coordinates(F.col("fp"), n_pivots))
    met = stored(met, "met")
    hubs = met.select("fp", "d", F.explode(F.array("lo", "hi")).alias("hub")).where(F.col("fp") != F.col("hub"))
    hubs = hubs.withColumn("d2", _coordinates(F.col("hub"), n_pivots))
    near = hubs.where(_linked(F.col("fp"), F.col("hub"), F.col("d"), F.col("d2"), radius, n_pivots))
    first = stored(connected_components(near, "fp", "hub"), "first")
    rooted = met.join(first.hint("merge"), met["fp"] == first["vertex"], "left").select("t", "m", "fp", "d", F.coalesce("component", "fp").alias("root"))
    apart = rooted.groupBy("t", "m").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("t", "m")
    left = rooted.join(apart.hint("merge"), ["t", "m"]).withColumn("cell", F.floor(F.col("d")[0] / F.lit(radius + 1)).cast("int"))
    left = stored(left, "apart")
    right = left.select(
        "t", "m", F.col("fp").alias("fp2"), F.col("root").alias("root2"), F.col("d").alias("d2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    )
    close = _linked(F.col("fp"), F.col("fp2"), F.col("d"), F.col("d2"), radius, n_pivots)
    pairs = left.join(right.hint("merge"), ["t", "m", "cell"]).where((F.col("root") < F.col("root2")) & close)
    second = connected_components(pairs.select("root", "root2").distinct(), "root", "root2")
    second = stored(second.select(F.col("vertex").alias("root"), F.col("component").alias("top")), "second")
    merged = first.select(F.col("vertex").alias("fp"), F.col("component").alias("root"))
    labels = distinct.select("fp").join(merged.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _with_root(stored(labels, "labels"), second).select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: the key, its fingerprint (long) and component_id.

    component_id is the smallest key reachable over links, null only if every key of the component
    is null. Repeated rows stay repeated. An empty or null text has fingerprint zero and is linked
    like any other; an empty table gives an empty result. Only the key and the text are read, so
    other columns may have any name.
    """
    marked = stored(fingerprints(docs.select(key, text), text, [key]), "fingerprints")
    distinct = stored(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("low")), "distinct")
    roots = fingerprint_components(distinct, radius)
    lows = stored(roots.join(distinct.hint("merge"), "fp"), "roots")
    ids = stored(lows.groupBy("root").agg(F.min("low").alias("component_id")), "ids")
    by_fp = _with_root(lows, ids).select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return marked.join(by_fp.hint("merge"), "fingerprint").select(key, "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents without all but one row of each component.

    The row with the smallest key stays, null keys last, and of rows that share it the one whose
    text has the smallest hash. Of rows alike in both one stays.
    """
    hashed = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = stored(fingerprints(rows.withColumn("hash", F.xxhash64("text")), "text", ["key", "hash"]), "fingerprints")
    distinct = stored(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "hash")).alias("low")), "distinct")
    lows = fingerprint_components(distinct, radius).join(distinct.hint("merge"), "fp").groupBy("root").agg(F.min("low").alias("low"))
    first = stored(lows.select(F.col("low.key").alias("_first key"), F.col("low.hash").alias("_first hash")), "first")
    # The rows to keep grow with the corpus, so they are never broadcast, not even while they are few.
    same = docs[f"`{key}`"].eqNullSafe(first["_first key"]) & (hashed == first["_first hash"])
    out = docs.join(first.hint("merge"), same, "left_semi")
    again = marked.groupBy("key", "hash").agg(F.count("*").alias("rows")).where("rows > 1")
    again = stored(again.select(F.col("key").alias("_again key"), F.col("hash").alias("_again hash")), "again")
    if again.isEmpty():
        return out
    again = again.hint("merge")
    same = docs[f"`{key}`"].eqNullSafe(again["_again key"]) & (hashed == again["_again hash"])
    once = out.join(again, same, "left_anti")
    repeated = out.join(again, same, "left_semi").withColumn("_row hash", hashed)
    return once.unionByName(repeated.dropDuplicates([key, "_row hash"]).drop("_row hash"))


def op6_simhash_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
