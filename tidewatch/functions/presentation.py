"""Texts that tell of scores and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_time(then: Column, now: Column, words: tuple[str, str, str, str, str] = ("just now", " min ago", " h ago", "yesterday", " days ago")) -> Column:
    """How long ago: minutes below an hour, hours below a day, yesterday below two, then days. words name the five."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, words[0]).when(minutes < 60, told(minutes, words[1])).when(hours < 24, told(hours, words[2])).when(days < 2, words[3]).otherwise(told(days, words[4]))


def report_text(heading: Column, level: Column, percent: Column, reasons: Column, most: int = 3) -> Column:
    """A heading, the level with its percentage, and the first reasons, a line each."""
    lines = F.transform(F.slice(reasons, 1, most), lambda r: F.concat(F.lit("- "), r))
    return F.array_join(F.concat(F.array(heading, F.concat(level, F.lit(" ("), percent.cast("string"), F.lit("%)"))), lines), "\n")
