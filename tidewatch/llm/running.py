"""Running totals over a whole table's order, and joins whose hot keys stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.components import stored

#: Parts whose totals are summed together, before the totals of such groups are.
PARTS_EACH = 1000
#: A key that holds over one in this many rows is joined by broadcast; fewer keys than this can.
LARGE = 1000


def offsets(sizes: DataFrame, part: str, values: list[str]) -> DataFrame:
    """(part, values): the sums over all earlier parts, for a table with one row per numbered part.

    Parts are summed by groups of PARTS_EACH, then the groups, so a window without a key sees one row
    for each thousand parts.
    """
    group = (F.col(part) / PARTS_EACH).cast("long")
    within = W.partitionBy("_g").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("_g", group)
    groups = rows.groupBy("_g").agg(*[F.sum(v).alias(v) for v in values])
    groups = groups.select("_g", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inner = rows.select(part, "_g", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(v) for v in values])
    return inner.join(groups, "_g").select(part, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def running(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with running totals: for name: column in values, name is the column's sum over all earlier rows in order.

    Rows are dealt to ranges of the order, summed within their range and moved on by the sums of the
    earlier ranges, of which there is one row each. The ranges come from a sample, so they are written
    once. Rows that are equal in order come in any order among themselves.
    """
    names = list(values)
    ranged = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    within = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(values[n]).over(within), F.lit(0)).alias(f"_r_{n}") for n in names])
    sizes = ranged.groupBy("_p").agg(*[F.sum(values[n]).alias(f"_o_{n}") for n in names])
    begin = F.broadcast(offsets(sizes, "_p", [f"_o_{n}" for n in names]))  # a row for each range
    out = local.join(begin, "_p")
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).cast("long").alias(n) for n in names])


def join_hot(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to the one row of values that each key has; values.size says how many rows a key has.

    Keys with over one in LARGE of all rows have their values, fewer than LARGE rows, broadcast, so
    that no task gets all rows of such a key; the others are joined by key. Both tables must be
    stored ones, as they are read twice.
    """
    large = F.col(size) * LARGE > total
    ahead, rest = values.where(large).drop(size), values.where(~large).drop(size)
    names = F.broadcast(ahead.select(key))
    hot = rows.join(F.broadcast(ahead), key)
    return hot.unionByName(rows.join(names, key, "left_anti").join(rest, key))
