"""Leakage-safe splits: whole groups go to one split, near the target shares."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import stored
from tidewatch.operators.relational import first_of, numbered, overlaps

SHARES = (("train", 0.80), ("validation", 0.10), ("test", 0.10))
DOMAIN_SHARES = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
#: Shares are taken as whole millionths, so that sums of lacking rows are exact.
UNIT = 1_000_000
#: Runs of groups of one size, counted, up to which their plans are broadcast.
FEW = 500_000


def run_plan(sizes: list[tuple[int, int]], shares: tuple[tuple[str, float], ...]) -> list[list[tuple[int, list[int]]]]:
    """How each run of equally large groups is dealt: phases (first rank, splits in turn), for runs (size, groups) from the largest size.

    A group goes to the split that lacks most rows, the first of equals, which then lacks its size
    less. Within a run all steps are alike, so the splits within a step of the one that lacks most
    take turns, for as many whole rounds as no other split comes before one of them; a run has no
    more phases than there are splits.
    """
    lacking = [round(share * UNIT) * sum(size * n for size, n in sizes) for _, share in shares]
    plans = []
    for size, n in sizes:
        step, phases, done = size * UNIT, [], 0
        while done < n:
            order = sorted(range(len(lacking)), key=lambda k: (-lacking[k], k))
            low = (lacking[order[0]] - step, -order[0])
            turn = [k for k in order if (lacking[k], -k) > low]
            rounds = n
            if len(turn) < len(order):
                other = order[len(turn)]
                rounds = max(1, min((lacking[k] - lacking[other] - (k > other)) // step + 1 for k in turn))
            rounds, rest = (rounds, 0) if rounds * len(turn) <= n - done else divmod(n - done, len(turn))
            phases.append((done, turn))
            for i, k in enumerate(turn):
                lacking[k] -= step * (rounds + (i < rest))
            done += rounds * len(turn) + rest
        plans.append(phases)
    return plans


def assigned(groups: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 42) -> DataFrame:
    """(label, group, rows, split) for groups (label, group, rows): largest first, each to the split that lacks most rows.

    Equal sizes go by a hash of the group; splits lacking equally much are taken in their order. The
    deal is one for all groups of a label and is not made one by one: groups of one size are a run,
    a run's plan follows from its size and length alone, and a group takes the split that the plan
    has for its rank within the run. Sizes of groups are distinct numbers that sum to no more than
    the rows, so the plans of a label are at most the square root of twice its rows.
    """
    hashed = groups.where(F.col("rows") > 0).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group").cast("string")))).withColumn("_o", -F.col("rows"))
    ranked = stored(numbered(hashed, ["label", "_o", "_h", "group"], "place"), "groups")
    runs = ranked.groupBy("label", "rows").agg(F.count("*").alias("n"), F.min("place").alias("_first"))

    def plan(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("rows", ascending=False)
        made = run_plan([(int(r), int(n)) for r, n in zip(found["rows"], found["n"], strict=True)], shares)
        return found.assign(phases=[[{"first": first, "turn": [shares[k][0] for k in turn]} for first, turn in p] for p in made])

    kind = groups.schema["label"].dataType.simpleString()
    plans = runs.groupBy("label").applyInPandas(plan, f"label {kind}, rows long, n long, _first long, phases array<struct<first:long,turn:array<string>>>")
    plans = stored(plans.select(F.col("label").alias("_l"), F.col("rows").alias("_s"), "_first", "phases"), "plans")
    plans = F.broadcast(plans) if plans.count() <= FEW else plans
    rank = F.col("place") - F.col("_first")
    phase = F.element_at(F.filter("phases", lambda p: p["first"] <= rank), -1)
    split = F.get(phase["turn"], ((rank - phase["first"]) % F.size(phase["turn"])).cast("int"))
    dealt = ranked.join(plans, ranked["label"].eqNullSafe(plans["_l"]) & (ranked["rows"] == plans["_s"]))
    return dealt.select("label", "group", "rows", split.alias("split"))


def split_by_group(
    df: DataFrame, group: str, label: str | None = None, shares: tuple[tuple[str, float], ...] = SHARES, fixed: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """Append split. fixed, a table (group, split), overrides the dealing for its groups."""
    keyed = df.select(F.col(group).alias("group"), (F.col(label) if label else F.lit(0)).alias("label"))
    groups = keyed.groupBy("label", "group").agg(F.count("*").alias("rows"))
    if fixed is not None:
        groups = groups.join(fixed.select("group"), "group", "left_anti").select("label", "group", "rows")
    # A group under two labels is dealt under each and takes the deal of its larger part, so that it stays whole.
    dealt = assigned(groups, shares, seed).withColumn("_o", -F.col("rows"))
    dealt = first_of(dealt, ["group"], ["_o", "label"]).select("group", "split")
    if fixed is not None:
        dealt = dealt.unionByName(fixed.select("group", "split"))
    named = dealt.withColumnRenamed("group", "_g")
    return df.join(named, F.col(group) == F.col("_g"), "left").drop("_g")


def split_summary(df: DataFrame, label: str, group: str, template: str | None = None) -> DataFrame:
    parts = [F.count("*").alias("rows"), F.count_distinct(group).alias("groups")]
    if template:
        parts.append(F.count_distinct(template).alias("templates"))
    return df.groupBy("split", label).agg(*parts)


def check_no_leakage(df: DataFrame, keys: list[list[str]]) -> None:
    """Raise an error if a group, a text or a domain is in more than one split."""
    for k in keys:
        if overlaps(df, k).limit(1).count():
            raise ValueError(f"{', '.join(k)} is in more than one split")


def balanced(phishing: DataFrame, normal: DataFrame, n: int, url: str = "url", domain: str = "domain", rank: str = "rank", seed: int = 42) -> DataFrame:
    """n phishing rows by a seeded hash and the n best-ranked normal rows whose domain no phishing row has.

    Rows carry label and come in a seeded order.
    """
    clean = normal.join(phishing.select(domain).distinct(), domain, "left_anti").select(*normal.columns)
    order = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(x).cast("string") for x in c]))
    some = phishing.orderBy(order(url), url).limit(n).withColumn("label", F.lit(1))
    best = clean.orderBy(rank, domain, url).limit(n).withColumn("label", F.lit(0))
    return some.unionByName(best, allowMissingColumns=True).orderBy(order(url, "label"), url)
