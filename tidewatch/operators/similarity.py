"""Exact set-similarity joins on token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST = 3
#: Postings of the smaller side up to which they are broadcast; counted, not guessed.
FEW_POSTINGS = 500_000


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.30, key: str = "id", tokens: str = "tokens", least: int = LEAST, few: int = FEW_POSTINGS) -> DataFrame:
    """(left_id, right_id, similarity) of pairs whose Jaccard similarity reaches the threshold, which is above 0.

    Tokens must be distinct within a row; rows with fewer than three have no similarity. If one
    side's postings (its tokens, one by one) are few, they are broadcast and the other side's tokens
    meet them where they are: shared tokens are counted before anything is shuffled. Otherwise
    pairs are found by prefix, size and position and verified on their whole sets.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    a = left.select(F.col(key).alias("left_id"), F.col(tokens).alias("a")).where(F.size("a") >= least)
    b = right.select(F.col(key).alias("right_id"), F.col(tokens).alias("b")).where(F.size("b") >= least)
    def is_few(df: DataFrame, column: str) -> bool:
        """Whether a side's postings are few; rows beyond the first so many, of three postings at least, need no counting."""
        n = df.select(F.size(column).alias("s")).limit(few + 1).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n")).first().n
        return n <= few

    if is_few(b, "b"):
        return _by_postings(a, "left_id", "a", b, "right_id", "b", threshold)
    if is_few(a, "a"):
        return _by_postings(b, "right_id", "b", a, "left_id", "a", threshold)
    return _by_prefix(a, b, threshold)


def _by_postings(many: DataFrame, many_id: str, many_tokens: str, few: DataFrame, few_id: str, few_tokens: str, threshold: float) -> DataFrame:
    """Pairs by the few side's broadcast postings: each common token adds one, summed within a task before the shuffle."""
    postings = F.broadcast(few.select(few_id, F.size(few_tokens).alias("m"), F.explode(few_tokens).alias("t")))
    each = many.select(many_id, F.size(many_tokens).alias("n"), F.explode(many_tokens).alias("t"))
    fit = (F.col("n") >= F.ceil(F.col("m") * threshold)) & (F.col("m") >= F.ceil(F.col("n") * threshold))
    shared = each.join(postings, "t").where(fit).groupBy(many_id, few_id, "n", "m").agg(F.count("*").alias("both"))
    similarity = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return shared.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _by_prefix(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs by common tokens of their prefixes.

    With tokens in one order, rarest first, a pair at the threshold shares a token among the first
    n - ceil(t n) + 1 of each side. A shared token at places i and j leaves at most
    1 + min(n - i, m - j) common ones, and a pair needs t / (1 + t) of both sizes: tokens that come
    too late in either row make no candidate. At low thresholds prefixes are nearly whole rows, so
    frequent tokens do meet many; that is what the postings of a small side are for.
    """
    counts = a.select(F.explode("a").alias("t")).unionAll(b.select(F.explode("b").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefix(rows: DataFrame, row_id: str, col: str, size: str, place: str) -> DataFrame:
        each = rows.select(row_id, F.size(col).alias(size), F.explode(col).alias("t")).join(counts, "t")
        ranked = each.withColumn(place, F.row_number().over(W.partitionBy(row_id).orderBy("f", "t")))
        return ranked.where(F.col(place) <= F.col(size) - F.ceil(F.col(size) * threshold) + 1).select(row_id, size, "t", place)

    pa, pb = prefix(a, "left_id", "a", "n", "i"), prefix(b, "right_id", "b", "m", "j")
    fit = (F.col("n") >= F.ceil(F.col("m") * threshold)) & (F.col("m") >= F.ceil(F.col("n") * threshold))
    # A hair less than needed, so that rounding loses no pair; candidates are verified.
    needed = (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-6
    reach = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed
    candidates = pa.join(pb, "t").where(fit & reach).select("left_id", "right_id").distinct()
    both = candidates.join(a, "left_id").join(b, "right_id")
    similarity = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return both.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def best_similarity(left: DataFrame, right: DataFrame, threshold: float = 0.30, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """(left_id, similarity): the most similar right row's similarity, for left rows that reach the threshold."""
    return similar_pairs(left, right, threshold, key, tokens).groupBy("left_id").agg(F.max("similarity").alias("similarity"))


def token_pairs(tokens: Column) -> Column:
    """All pairs (x, y), x < y, of an array's distinct tokens."""
    t = F.array_sort(F.array_distinct(tokens))
    return F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def sharing_pairs(df: DataFrame, key: str = "id", tokens: str = "tokens", least: int = 2) -> DataFrame:
    """(a, b), a < b, of rows that share at least two tokens, once each.

    Rows with the same tokens are linked to the smallest of them first, so pairs of tokens are made
    once for each distinct set and not for each row. Sets meet under pairs of their tokens, and each
    such pair links its sets to the smallest of them only (a star), so a common pair of tokens gives
    as many links as sets. The links connect what all the pairs would connect.
    """
    if least != 2:
        raise ValueError("links are made for two shared tokens")
    rows = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") >= 2)
    sets = rows.groupBy("t").agg(F.min("id").alias("low"))
    same = rows.join(sets, "t").where("low < id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    each = sets.select("low", F.explode(token_pairs(F.col("t"))).alias("d")).select("low", "d.x", "d.y")
    first = each.groupBy("x", "y").agg(F.min("low").alias("a"))
    return each.join(first, ["x", "y"]).where("a < low").select("a", F.col("low").alias("b")).union(same).distinct()
