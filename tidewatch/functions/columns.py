"""Small column helpers that rules share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times but computes it once, in conditions too."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def any_in(text: Column, parts: Iterable[str]) -> Column:
    """Whether any of the parts is in the text; parts are literals of a list of fixed length."""
    tests = [text.contains(p) for p in parts]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def number_in(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in parts], F.lit(0))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))


def rounded(x: Column, places: int) -> Column:
    """x, a double, to so many places as SQL engines round doubles: the product with a power of ten, halves away from zero.

    F.round goes by a number's decimal text, so it differs where a half has no exact double.
    """
    return F.round(x.cast("double") * float(10**places)) / float(10**places)


def cascade(pairs: Iterable[tuple[Column, Column | str]], default: Column | str) -> Column:
    """The value of the first condition that holds."""
    pairs = list(pairs)
    out = F.when(pairs[0][0], pairs[0][1])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out.otherwise(default)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def require_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df, or an error if a row's text is null or blank."""
    require_columns(df, [text])
    if not df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").isEmpty():
        raise ValueError(f"{text} is empty")
    return df
