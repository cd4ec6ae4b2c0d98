"""What the corpus operators share: reading tables, words, and Arrow passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that a word, [^\x20\x09-\x0D]+, may not hold.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_hash(key: Column) -> Column:
    """crc32 of the key as text; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times but computes, and holds, it once."""
    return F.get(F.transform(F.array(value), use), 0)


def with_arrow_columns(
    df: DataFrame, inputs: dict[str, Column], outputs: list[T.StructField], fn: Callable[[pa.RecordBatch], list], keep: list[str] | None = None
) -> DataFrame:
    """Append columns that fn computes batch by batch.

    fn gets a batch with the input columns and returns one array (or list) per output field. Kept
    columns pass through under positional names, so columns of any name may be in df.
    """
    kept = df.columns if keep is None else keep
    inner = df.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)], *[c.alias(f"_in_{n}") for n, c in inputs.items()]
    )
    fields = inner.schema.fields[: len(kept)] + [T.StructField(f"_out_{f.name}", f.dataType) for f in outputs]
    schema = T.StructType(fields)
    n_kept, names = len(kept), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in outputs]
        for batch in batches:
            given = pa.RecordBatch.from_arrays(batch.columns[n_kept:], names=names)
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(fn(given), types, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:n_kept] + made, names=[f.name for f in fields])

    out = inner.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"_out_{f.name}").alias(f.name) for f in outputs]
    )
