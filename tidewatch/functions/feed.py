"""Alert titles: dates, categories, keywords and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.columns import any_in, cascade
from tidewatch.lexicons import KOREAN, SUMMARIES, Profile

DATE = r"(20[0-9]{2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})"


def iso_date(value: Column) -> Column:
    """The first date such as 2024.1.2, 2024-01-02 or 2024/1/2 as 2024-01-02; "" without one."""
    part = lambda i: F.regexp_extract(value, DATE, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise("")


def is_alert(title: Column, profile: Profile = KOREAN) -> Column:
    return any_in(title, profile.alert_keywords)


def category(title: Column, profile: Profile = KOREAN) -> Column:
    def all_in(words: tuple[str, ...]) -> Column:
        out = title.contains(words[0])
        for w in words[1:]:
            out = out & title.contains(w)
        return out

    return cascade([(all_in(words), F.lit(name)) for words, name in profile.title_categories], profile.title_category_default)


def keywords(title: Column, profile: Profile = KOREAN) -> Column:
    """The first five keywords in the title, whatever their case; the default alone if there is none."""
    lower = F.lower(title)
    found = F.filter(F.array(*[F.when(lower.contains(k.lower()), F.lit(k)) for k in profile.title_keywords]), lambda k: k.isNotNull())
    return F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(F.array(F.lit(profile.title_default)))


def clean_title(title: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s\xa0]+", " ")
    return F.regexp_replace(squeezed, "^ | $", "")


def summary(source: Column, title: Column) -> Column:
    """A source's sentence about a title without its leading bracket."""
    bare = F.trim(F.regexp_replace(clean_title(title), r"^\s*\[.*?\]\s*", ""))

    def told(name: str) -> Column:
        before, after = SUMMARIES[name].split("{title}")
        return F.concat(F.when(F.lit("{source}" in before), source).otherwise(""), F.lit(before.replace("{source}", "")), bare, F.lit(after))

    return cascade([(source == n, told(n)) for n in SUMMARIES if n], told(""))
