"""The alert feed: one stream of items from several sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import feed as A
from tidewatch.lexicons import KOREAN, Profile
from tidewatch.operators.relational import concat, first_of


def classified(items: DataFrame, profile: Profile = KOREAN) -> DataFrame:
    """Security alerts among items (id, source, title, published_at, url), with category, keywords and summary."""
    t = F.col("title")
    rows = items.where(A.is_alert(t, profile))
    return rows.withColumns({"category": A.category(t, profile), "keywords": A.keywords(t, profile), "summary": A.summary(F.col("source"), t)})


def distinct_items(items: DataFrame) -> DataFrame:
    """The first item of each id, and of those the first of each URL; newest first, then by id. Items without a URL all stay."""
    date = F.coalesce("published_at", F.lit(""))
    newest = items.withColumn("_o", F.when(date == "", "~").otherwise(F.translate(date, "0123456789", "9876543210")))
    by_id = first_of(newest, ["id"], ["_o", "url"])
    with_url = first_of(by_id.where("url <> ''"), ["url"], ["_o", "id"])
    return with_url.unionByName(by_id.where("url IS NULL OR url = ''")).drop("_o")


def top_items(items: DataFrame, n: int = 20) -> DataFrame:
    return items.orderBy(F.desc("published_at"), "id").limit(n)


def gathered(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The items of all sources that can be read, and the errors of the others."""
    found, errors = [], {}
    for name, read in sources.items():
        try:
            rows = read()
            rows.limit(1).count()
            found.append(rows)
        except Exception as e:  # a source that fails doesn't stop the others
            errors[name] = str(e)
    return (concat(*found) if found else None), errors
