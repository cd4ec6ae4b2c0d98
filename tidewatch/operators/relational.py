"""Deduplication, conflicts, anti-joins and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import require_columns
from tidewatch.operators.components import stored


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of each key. The order must decide; nulls in keys are equal."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def without_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose key has one label only."""
    mixed = df.groupBy(key).agg(F.count_distinct(label).alias("n")).where("n > 1").select(key)
    return df.join(mixed, key, "left_anti").select(*df.columns)


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("rows")).where("labels > 1")


def not_in(df: DataFrame, other: DataFrame, keys: list[str], trim: bool = False) -> DataFrame:
    """Rows without a match in other, compared on trimmed keys if asked for."""
    prepared = [(F.trim(F.col(k)) if trim else F.col(k)).alias(f"_o{i}") for i, k in enumerate(keys)]
    right = other.select(*prepared).distinct()
    test = [(F.trim(df[k]) if trim else df[k]) == right[f"_o{i}"] for i, k in enumerate(keys)]
    return df.join(right, reduce(lambda a, b: a & b, test), "left_anti")


def overlaps(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(*keys).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, over the union of columns in the order of their first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def converted(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns, null where it lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def text_column(df: DataFrame, candidates: tuple[str, ...] = ("text", "content", "message", "sentence")) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no text column among {', '.join(df.columns)}")


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Append 0, 1, 2 … in order, without gathering the rows in one task.

    Rows are ranged by the order, counted by range, and numbered within their range. The ranges come
    from a sample, so they are written once: made twice, they could differ.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    within = W.partitionBy("_p").orderBy(*order)
    counted = stored(ranged.withColumn("_n", F.row_number().over(within)), "numbered")
    sizes = counted.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = counted.join(F.broadcast(starts.select("_p", "_s")), "_p")  # a row for each range
    return out.withColumn(name, (F.col("_s") + F.col("_n") - 1).cast("long")).drop("_p", "_n", "_s")


#: Rows, counted, up to which a looked-up side is broadcast.
FEW = 500_000


def looked_up(df: DataFrame) -> DataFrame:
    """df, written before, as the side of a join that is looked up: broadcast while its rows are few, else hashed within partitions, so that the other side is never sorted."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("shuffle_hash")


def labelled(df: DataFrame, text: str, label: str, classes: dict[int, int] | None = None) -> DataFrame:
    """Rows with a text and a label: trimmed texts, labels mapped, others dropped.

    Without classes the labels must be 0 and 1; any other raises an error.
    """
    require_columns(df, [text, label])
    rows = df.dropna(subset=[text, label]).withColumn(text, F.trim(F.col(text))).where(F.col(text) != "")
    if classes is not None:
        mapped = reduce(lambda out, p: out.when(F.col(label) == p[0], p[1]), classes.items(), F.when(F.lit(False), 0))
        return rows.withColumn(label, mapped).dropna(subset=[label])
    rows = rows.withColumn(label, F.col(label).cast("int"))
    wrong = rows.where(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).limit(1).count()
    if wrong:
        raise ValueError("labels must be 0 or 1")
    return rows


def common(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that both have."""
    return df.select(*keys).intersect(other.select(*keys))


def group_summary(df: DataFrame, group: list[str], first: str) -> DataFrame:
    """Rows of each group and its smallest value of a column, as its first whatever the order of rows."""
    return df.groupBy(*group).agg(F.count("*").alias("rows"), F.min(first).alias("first"))


def flag_summary(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """How many rows of each label have a flag, and their share."""
    each = [x for c in flags for x in (F.sum(c).alias(f"{c}_sum"), F.round(F.avg(c), 4).alias(f"{c}_mean"))]
    return df.groupBy(label).agg(F.count("*").alias("rows"), *each)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Rows by two columns, a column for each value."""
    out = df.groupBy(row).pivot(column, values).count()
    return out.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def newest(df: DataFrame, by: list[str], time: str, tie: str, n: int = 5) -> DataFrame:
    """The n newest rows of each group."""
    along = W.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(along)).where(F.col("_n") <= n).drop("_n")


def bar_percent(counts: DataFrame, count: str = "count") -> DataFrame:
    """Append percent: a count over the largest, half a percent rounded up. One row for each bar of a ranking."""
    most = counts.agg(F.greatest(F.max(count), F.lit(1)).alias("_most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("percent", F.floor(F.col(count) * 100 / F.col("_most") + 0.5).cast("int")).drop("_most")  # one row


def first_present(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """The columns of names, each the first value that is not null of its candidates that df has."""
    found = {name: [F.col(c) for c in candidates if c in df.columns] for name, candidates in names.items()}
    return df.select(*[(F.coalesce(*c) if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def value_counts(df: DataFrame, column: str | Column) -> DataFrame:
    key = F.col(column) if isinstance(column, str) else column
    return df.groupBy(key.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def tld_statistics(df: DataFrame, tld: str, label: str, least: int = 20, rate: float = 0.90) -> DataFrame:
    """Normal and phishing rows of each ending; a candidate has enough phishing rows at a high rate."""
    out = df.groupBy(tld).agg(F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("phishing"))
    out = out.withColumn("rate", F.round(F.col("phishing") / (F.col("normal") + F.col("phishing")), 6))
    return out.withColumn("candidate", (F.col("phishing") >= least) & (F.col("rate") >= rate))


def quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """(group, q0, q1 …): exact quantiles of a column in each group, interpolated between neighbours; nulls don't count.

    Equal values are counted first. The counted values are ranged by group and value, so a group of
    any size is spread over as many ranges as it needs; counts of earlier ranges, a row for each
    group and range, give every value its rank, and only the values at the wanted ranks go on.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    # Ranges come from a sample: written once, as made twice they could differ.
    ranged = stored(counted.repartitionByRange(*group, "_v").withColumn("_p", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_p", *group).agg(F.sum("_n").alias("_c"))
    earlier = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"_s": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), "_all": F.sum("_c").over(W.partitionBy(*group))})
    within = W.partitionBy("_p", *group).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_b", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    same = [local[c].eqNullSafe(parts[c]) for c in ("_p", *group)]
    rows = local.join(parts, reduce(lambda x, y: x & y, same)).select(*[local[c] for c in group], "_v", (F.col("_s") + F.col("_b")).alias("_first"), "_n", "_all")
    place = [(F.col("_all") - 1) * F.lit(q) for q in at]
    holds = lambda rank: (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n"))
    ends = [(F.floor(x), F.ceil(x), x - F.floor(x)) for x in place]
    hit = reduce(lambda x, y: x | y, [holds(r) for low, high, _ in ends for r in (low, high)])
    found = rows.where(hit).groupBy(*group)
    picked = [F.max(F.when(holds(r), F.col("_v"))).alias(f"_{name}{i}") for i, (low, high, _) in enumerate(ends) for name, r in (("l", low), ("h", high))]
    shares = [F.max(x).alias(f"_w{i}") for i, (_, _, x) in enumerate(ends)]
    out = found.agg(*picked, *shares)
    return out.select(*group, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(f"q{i}") for i in range(len(at))])


def feature_quantiles(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Count, mean, median, p75, p90, p95 and maximum of each feature by class."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    rows = df.select(F.col(label).alias("class"), pairs.alias("p")).select("class", "p.feature", "p.value")
    sums = rows.groupBy("feature", "class").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    q = quantiles(rows, ["feature", "class"], "value", (0.5, 0.75, 0.9, 0.95)).withColumnsRenamed({"feature": "_f", "class": "_c"})
    out = sums.join(q, sums["feature"].eqNullSafe(q["_f"]) & sums["class"].eqNullSafe(q["_c"]), "left")
    named = [F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("median", "p75", "p90", "p95"))]
    return out.select("feature", "class", "n", F.round("mean", 6).alias("mean"), *named, F.round("max", 6).alias("max"))
