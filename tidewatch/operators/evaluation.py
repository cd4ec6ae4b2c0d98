"""Classifier evaluation: confusion, sweeps, curves, errors, robustness and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import rounded
from tidewatch.operators.components import stored

#: The thresholds of a sweep, 0.05 to 0.95, and of the short one for rules.
SWEEP = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))
EPS = 1e-12
PLACES = 6


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def counts(label: Column, predicted: Column) -> list[Column]:
    cell = lambda y, p: F.count_if((label == y) & (predicted == p))
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def with_ratios(df: DataFrame) -> DataFrame:
    """Append accuracy, precision, recall and f1 to rows with tn, fp, fn and tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    r = lambda a, b: rounded(ratio(a, b), PLACES)
    return df.withColumns({"accuracy": r(tp + tn, tn + fp + fn + tp), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn)})


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return with_ratios(df.groupBy(*(by or [])).agg(*counts(F.col(label), F.col(predicted))))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Confusion and ratios at each threshold (predicted if score >= threshold), from one histogram.

    A row falls in the cell of the largest threshold that it reaches; sums over cells from above
    give every threshold's counts, so rows are counted once whatever the number of thresholds.
    """
    limits = F.array(*[F.lit(t) for t in sorted(thresholds)])
    cell = F.size(F.filter(limits, lambda t: F.col(score) >= t))
    cells = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(sorted(thresholds), 1)], "cell int, threshold double")
    every = cells.join(grid, "cell", "full")
    up = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)  # a row for each threshold
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = every.select("threshold", F.sum(n("p")).over(up).alias("tp"), F.sum(n("n")).over(up).alias("fp"), F.sum(n("p")).over(all_).alias("np"), F.sum(n("n")).over(all_).alias("nn"))
    rows = rows.where("threshold IS NOT NULL").select("threshold", (F.col("nn") - F.col("fp")).alias("tn"), "fp", (F.col("np") - F.col("tp")).alias("fn"), "tp")
    return with_ratios(rows)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """By f1, recall, precision; of equal ones the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def threshold_for_recall(sweep: DataFrame, recall: float) -> DataFrame:
    """Of the thresholds with that recall, by precision, f1 and the highest threshold."""
    return sweep.where(F.col("recall") >= recall).orderBy(F.desc("precision"), F.desc("f1"), F.desc("threshold")).limit(1)


def curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tp, fp, precision, recall, f1) at every distinct score, highest first.

    Scores are first counted, so equal ones are one row; ranges of scores then carry sums from one
    to the next, and no task holds all scores.
    """
    rows = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    # Ranges come from a sample: written once, as made twice they could differ.
    ranged = stored(rows.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "curve")
    within = W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumns({"tp": F.sum("p").over(within), "fp": F.sum("n").over(within)})
    sums = ranged.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    before, all_ = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = sums.select("part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"), F.sum("sp").over(all_).alias("np"), F.sum("sn").over(all_).alias("nn"))
    out = run.join(F.broadcast(starts), "part")  # a row for each range
    out = out.withColumns({"tp": F.col("tp") + F.col("bp"), "fp": F.col("fp") + F.col("bn")})
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("np"))
    f1 = 2 * precision * recall / (precision + recall + EPS)
    return out.select("score", "tp", "fp", F.col("p").alias("positives"), F.col("n").alias("negatives"), "np", "nn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """roc_auc (null with one class) and average_precision, exact; tied scores share their rank."""
    c = curve(df, label, score)
    # Of each tie's negatives, the positives above count whole and those tied count half.
    above = (F.col("tp") - F.col("positives")) * F.col("negatives") + 0.5 * F.col("positives") * F.col("negatives")
    out = c.agg(F.sum(above.cast("double")).alias("a"), F.max("np").alias("np"), F.max("nn").alias("nn"), F.sum(F.col("precision") * F.col("positives")).alias("s"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return out.select(F.when(both, rounded(F.col("a") / (F.col("np") * F.col("nn")), PLACES)).alias("roc_auc"), rounded(ratio(F.col("s"), F.col("np")), PLACES).alias("average_precision"))


def error_type(label: Column, predicted: Column) -> Column:
    return F.when(label == predicted, "CORRECT").when(predicted == 1, "FP").otherwise("FN")


def error_examples(df: DataFrame, n: int = 20, key: str = "id", score: str = "score", label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The n worst errors of each kind: false positives by falling, false negatives by rising score."""
    y, p = F.col(label), F.col(predicted)
    wrong = df.withColumn("type", error_type(y, p))
    high = wrong.where((y == 0) & (p == 1)).orderBy(F.desc(score), key).limit(n)
    return high.unionByName(wrong.where((y == 1) & (p == 0)).orderBy(score, key).limit(n))


def group_errors(df: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Totals, accuracy, errors and error rates of each group; none gives one overall row."""
    y, p = F.col(label), F.col(predicted)
    out = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(y == p).alias("correct"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == 0).alias("normals"), F.count_if(y == 1).alias("phishing"),
    )
    r = lambda a, b: rounded(ratio(F.col(a), F.col(b)), PLACES)
    out = out.withColumns({"errors": F.col("fp") + F.col("fn"), "accuracy": r("correct", "total"), "fp_rate": r("fp", "normals"), "fn_rate": r("fn", "phishing")})
    return out.drop("normals", "phishing").orderBy(F.desc("errors"), "accuracy", *by)


def weaknesses(df: DataFrame, levels: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The groups of several levels in one ranking."""
    parts = [group_errors(df, [c], label, predicted).withColumn("level", F.lit(c)).withColumnRenamed(c, "name") for c in levels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("errors"), "accuracy", "level", "name")


def pair_accuracy(df: DataFrame, pair: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The share of pairs of which every row is right."""
    pairs = df.groupBy(pair).agg(F.bool_and(F.col(label) == F.col(predicted)).alias("ok"))
    return pairs.agg(F.count("*").alias("pairs"), rounded(F.avg(F.col("ok").cast("int")), PLACES).alias("accuracy"))


def robustness(df: DataFrame, condition: str = "condition", key: str = "id", original: str = "original", label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Each condition's confusion, and of the phishing rows caught in the original how many stay caught or now evade.

    The drops are those of accuracy, recall and f1 against the original condition.
    """
    y, p = F.col(label), F.col(predicted)
    base = df.where(F.col(condition) == original).select(key, p.alias("_was"))
    joined = df.join(base, key)
    caught = (y == 1) & (F.col("_was") == 1)
    rows = with_ratios(joined.groupBy(condition).agg(*counts(y, p), F.count_if(caught & (p == 1)).alias("retained"), F.count_if(caught & (p == 0)).alias("evaded")))
    rows = rows.withColumn("retention", rounded(ratio(F.col("retained"), F.col("retained") + F.col("evaded")), PLACES))
    first = rows.where(F.col(condition) == original).select(*[F.col(c).alias(f"_{c}") for c in ("accuracy", "recall", "f1")])
    out = rows.join(F.broadcast(first))  # one row
    drops = {f"{c}_drop": rounded(F.col(f"_{c}") - F.col(c), PLACES) for c in ("accuracy", "recall", "f1")}
    return out.withColumns(drops).drop("_accuracy", "_recall", "_f1")


def family_errors(df: DataFrame, family: str, label: str = "label", predicted: str = "predicted", score: str = "score") -> DataFrame:
    """False-positive rate and mean score of each family's normal rows."""
    rows = df.where(F.col(label) == 0).groupBy(family)
    return rows.agg(F.count("*").alias("rows"), rounded(F.avg(F.col(predicted).cast("double")), PLACES).alias("fp_rate"), rounded(F.avg(score), PLACES).alias("mean_score"))


def promotion_gate(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of each with f1, precision and fp: PROMOTE unless f1 or precision falls or fp rises."""
    a = current.select(*[F.col(c).alias(f"a_{c}") for c in ("f1", "precision", "fp")])
    b = candidate.select(*[F.col(c).alias(f"b_{c}") for c in ("f1", "precision", "fp")])
    both = a.limit(1).join(F.broadcast(b.limit(1)))  # one row each
    d = {f"delta_{c}": rounded(F.col(f"b_{c}") - F.col(f"a_{c}"), PLACES) for c in ("f1", "precision")} | {"delta_fp": F.col("b_fp") - F.col("a_fp")}
    rows = both.withColumns(d)
    ok = (F.col("delta_f1") >= 0) & (F.col("delta_precision") >= 0) & (F.col("delta_fp") <= 0)
    return rows.select("delta_f1", "delta_precision", "delta_fp", F.when(ok, "PROMOTE").otherwise("REJECT").alias("decision"))
