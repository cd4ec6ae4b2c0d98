"""Tables that are replaced whole, and stay readable whatever happens while a new version is written.

A version is a folder of its own. It becomes current when its pointer, one small file whose name is
the version's number, is renamed into place; a rename happens whole or not at all and never over an
existing file, so of two writers one gets an error. Readers take the highest number. A failure before
the rename leaves a folder that no pointer names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Versions:
    """The versions of one table under a folder that every driver and executor can reach."""

    def __init__(self, spark: SparkSession, path: str, form: str = "parquet") -> None:
        self.spark, self.path, self.form = spark, path.rstrip("/"), form
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def numbers(self) -> list[int]:
        """The numbers of all versions, ascending. Only an absent folder counts as none; other errors are errors."""
        if not self._files.exists(self._path("pointers")):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path("pointers"))]
        return sorted(int(n) for n in names if n.isdigit())

    def folder(self, number: int | None = None) -> str | None:
        """The folder of a version, by default the current one; None where there is no version."""
        known = self.numbers()
        if number is None and not known:
            return None
        number = known[-1] if number is None else number
        if number not in known:
            raise ValueError(f"{self.path} has no version {number}")
        with_ = self._files.open(self._path("pointers", f"{number:012d}"))
        try:
            return with_.readUTF()
        finally:
            with_.close()

    def prepare(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        """Write a version's rows; nothing reads them before commit names their folder."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.format(self.form).partitionBy(*partition_by).save(f"{self.path}/{name}")
        return name

    def commit(self, name: str) -> int:
        """Make a written folder the current version and return its number."""
        number = (self.numbers() or [0])[-1] + 1
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.writeUTF(name)
        finally:
            out.close()
        self._files.mkdirs(self._path("pointers"))
        option = getattr(self._hadoop, "Options$Rename")
        plain = self.spark._sc._gateway.new_array(option, 1)
        plain[0] = option.NONE
        self._context.rename(draft, self._path("pointers", f"{number:012d}"), plain)
        return number

    def publish(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Replace the table by df, which may have been read from its current version."""
        return self.commit(self.prepare(df, partition_by))

    def read(self, schema: T.StructType | str | None = None, number: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the current one; None where there is no version."""
        name = self.folder(number)
        if name is None:
            return None
        reader = self.spark.read.format(self.form)
        return (reader.schema(schema) if schema is not None else reader).load(f"{self.path}/{name}")

    def rollback(self) -> int:
        """Make the version before the current one current again, as a version of its own number."""
        known = self.numbers()
        if len(known) < 2:
            raise ValueError(f"{self.path} has no version to go back to")
        return self.commit(self.folder(known[-2]))

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that the last versions don't name, and their pointers; says how many folders went.

        Readers of older versions, and writers that have not committed yet, must be done.
        """
        known = self.numbers()
        needed = {self.folder(n) for n in known[-keep:]}
        for n in known[:-keep]:
            self._files.delete(self._path("pointers", f"{n:012d}"), False)
        if not self._files.exists(self._path("data")):
            return 0
        gone = [f.getPath() for f in self._files.listStatus(self._path("data")) if f"data/{f.getPath().getName()}" not in needed]
        for p in gone:
            self._files.delete(p, True)
        return len(gone)
