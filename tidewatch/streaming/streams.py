"""Structured Streaming: the feed's cycle, running case status, and counts over time.

Sliding and session windows over events are extensions; the rest follows the report service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.lexicons import KOREAN, Profile
from tidewatch.operators import feed as A
from tidewatch.operators import graph as G
from tidewatch.operators import incremental
from tidewatch.operators.components import stored
from tidewatch.operators.reports import status_of
from tidewatch.sources import sinks
from tidewatch.sources.versions import Versions

EVERY = "30 minutes"


def feed_cycle(items: DataFrame, cache: str, checkpoint: str, every: str | None = EVERY, profile: Profile = KOREAN) -> StreamingQuery:
    """Every cycle, classify the new items, merge them with all cached ones and replace the cache; readers take the newest.

    A batch without alerts leaves the cache as it is. Without a cycle it runs over what is there and ends.
    """
    spark = items.sparkSession

    def refresh(batch: DataFrame, number: int) -> None:
        new = A.classified(batch, profile)
        if new.isEmpty():
            return
        # A cache that can't be read is an error: only where there is none yet may the new items stand alone.
        old = Versions(spark, cache, "json").read(new.schema)
        sinks.feed(A.distinct_items(new if old is None else old.unionByName(new, allowMissingColumns=True)), cache)

    writer = items.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_status(reports: DataFrame) -> DataFrame:
    """Report count and status of each case so far; update or complete mode."""
    counts = reports.groupBy("case_key").agg(F.count("*").alias("report_count"), F.max((F.col("source") == "seed").cast("int")).alias("seed"))
    return counts.select("case_key", "report_count", status_of(F.col("report_count"), F.col("seed") == 1).alias("status"))


def promotions(reports: DataFrame, suspected: int = 2, confirmed: int = 5) -> DataFrame:
    """A row (case_key, report_count, status) whenever a case's status changes; append or update mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, seed, last = state.get if state.exists else (0, False, "")
        for batch in batches:
            count += len(batch)
            seed = bool(seed or (batch["source"] == "seed").any())
        status = "confirmed" if seed or count >= confirmed else "suspected" if count >= suspected else "pending"
        state.update((count, seed, status))
        if status != last:
            yield pd.DataFrame({"case_key": [key[0]], "report_count": [count], "status": [status]})

    return reports.select("case_key", "source").groupBy("case_key").applyInPandasWithState(
        step, "case_key string, report_count long, status string", "n long, seed boolean, status string", "update", GroupStateTimeout.NoTimeout
    )


def last_day(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour", slide: str = "1 hour") -> DataFrame:
    """Events of each key in every 24 hours, slid by the hour; rows later than the watermark are left out."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, "24 hours", slide), key).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap that long."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def recompute(reports: DataFrame, build: Callable[[], None], checkpoint: str) -> StreamingQuery:
    """Call build after every batch that brings reports, as to refresh the graph."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            build()

    return reports.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(reports: DataFrame, state: str, checkpoint: str, profile: Profile = KOREAN, every: str | None = None) -> StreamingQuery:
    """Add every batch of new reports to the clusters kept under state; incremental.clusters reads them.

    A batch that is delivered twice is added once, as it is written under its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        incremental.add(state, stored(G.prepared(batch, profile), "prepared"), number)

    writer = reports.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
