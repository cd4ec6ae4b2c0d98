"""Model versions as a table of events: promotion, rollback and what a version needs to be promoted.

Events are pure tables here; ``ModelVersions`` keeps them in a store whose versions replace each other by one rename.

A version's files stay where they were written, so the live version is the last event's, promotion
keeps the one before it as its backup, and a rollback is one more event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.versions import Versions

EVENTS = "n long, version string, previous string, action string"


def no_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def live(events: DataFrame) -> DataFrame:
    """(version, previous) of the last event; no row before the first promotion."""
    return events.orderBy(F.desc("n")).limit(1).select("n", "version", "previous")


def _with(events: DataFrame, version: str, previous: str | None, action: str, n: int) -> DataFrame:
    return events.unionByName(events.sparkSession.createDataFrame([(n, version, previous, action)], EVENTS))


def promote(events: DataFrame, version: str) -> DataFrame:
    """The events with a version's promotion; the live one becomes its previous."""
    last = live(events).first()
    return _with(events, version, last.version if last else None, "promote", last.n + 1 if last else 1)


def rollback(events: DataFrame) -> DataFrame:
    """The events with a return to the previous of the live version; an error where it has none."""
    last = live(events).first()
    if last is None or last.previous is None:
        raise ValueError("no version to go back to")
    before = events.where((F.col("version") == last.previous) & (F.col("action") == "promote")).orderBy(F.desc("n")).limit(1).first()
    return _with(events, last.previous, before.previous if before else None, "rollback", last.n + 1)


def check_model(spark: SparkSession, path: str, tables: tuple[str, ...]) -> None:
    """Raise an error if a stored model lacks a table or has one without rows."""
    for name in tables:
        try:
            empty = spark.read.parquet(f"{path}/{name}").limit(1).count() == 0
        except Exception as e:
            raise ValueError(f"{path} has no table {name}") from e
        if empty:
            raise ValueError(f"table {name} of {path} is empty")


class ModelVersions:
    """The live model of a folder: what was promoted or rolled back is there after a crash, or was not done at all."""

    def __init__(self, spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> None:
        self.spark, self.tables = spark, tables
        self.store = Versions(spark, path)

    def events(self) -> DataFrame:
        found = self.store.read(EVENTS)
        return no_versions(self.spark) if found is None else found

    def live(self) -> str | None:
        last = live(self.events()).first()
        return last.version if last else None

    def promote(self, version: str) -> None:
        """Make a stored model, named by its folder, the live one, if all its tables are there."""
        check_model(self.spark, version, self.tables)
        self.store.publish(promote(self.events(), version).coalesce(1))

    def rollback(self) -> None:
        self.store.publish(rollback(self.events()).coalesce(1))
