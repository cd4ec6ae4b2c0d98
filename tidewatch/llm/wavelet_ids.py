"""Token ids of documents in wavelet-matrix files, one succinct file per shard.

Documents are ranged by key; each range's task encodes its texts, ends every document with the end
id and cuts the ids into shards of whole documents. A shard is one zstd-compressed Parquet file of
one row: the keys and lengths of its documents, and a wavelet matrix of its ids, which is one plane
of bits per bit of an id, the top one first, each with the number of zeros in it and a directory of
ones before every 512th bit. From that one row an id at a place, the occurrences of an id before a
place (rank) and the place of its k-th occurrence (select) come in one step per plane; nothing else
is kept of the ids. Spark's writer commits the files, so a lost or repeated task leaves none twice.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table
from tidewatch.llm.running import offsets
from tidewatch.llm.token_counts import byte_letters
from tidewatch.operators.components import shared_folder

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: A shard is closed when it holds this many ids; it holds whole documents.
SHARD_TOKENS = 1 << 22
#: Bytes of text that a range has on average.
RANGE_BYTES = 32 << 20
#: Bits from one entry of a rank directory to the next.
BLOCK = 512
#: Letters that texts are cut after; all are letters to the pre-tokenizer.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CUT = re.compile(rf"(?<=[{LETTERS}])(?=[\x00-\x40\x5b-\x60\x7b-\x7f])|(?<=[!-@\[-`{{-~])(?=[ \t\n])")
ONE = re.compile(rf" ?[{LETTERS}]+\Z")
#: What may stand next to a blank at which a text is cut: no white space to any library.
SAFE = "!-~\u00c0-\u024f"
FIRST = re.compile(rf"[{SAFE}]")
LAST = re.compile(rf"[{SAFE}]\Z")
#: Pieces, of so many characters at most, whose ids a task remembers.
REMEMBERED, SHORT = 1_500_000, 40
#: Ids that are moved at a time while planes are made or undone.
AT_ONCE = 1 << 18
#: Places that are returned at a time.
DECODED = 1 << 20


class WaveletMatrix:
    """Access, rank and select over a sequence of ids below 2 ** levels."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.levels = n, zeros, len(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]
        self._words: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"an id does not fit {levels} bits")
        zeros, planes, ranks = [], [], []
        kind = np.uint16 if levels <= 16 else np.uint32
        row = np.ascontiguousarray(ids, kind)
        for level in range(levels - 1, -1, -1):
            bit = row & kind(1 << level) != 0
            plane = np.packbits(bit, bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(plane).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            planes.append(plane.tobytes())
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]).tobytes())
            low, high = [row[:0]], []
            for k in range(0, len(row), AT_ONCE):
                part, ones = row[k : k + AT_ONCE], bit[k : k + AT_ONCE]
                low.append(part[np.flatnonzero(~ones)])
                high.append(part[np.flatnonzero(ones)])
            zeros.append(sum(map(len, low)))
            row = np.concatenate(low + high)
        return cls(len(ids), zeros, planes, ranks)

    def _bits(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """The ones of a plane before each place."""
        block = at // BLOCK
        out = self.ranks[level][block].astype(np.int64)
        words = self._words.get(level)
        if words is None:
            words = self._words[level] = np.pad(self.planes[level], (0, BLOCK // 8)).view(np.uint64)
        inside, first = at - block * BLOCK, block * (BLOCK // 64)
        for k in range(BLOCK // 64):
            left = np.clip(inside - 64 * k, 0, 64)
            if not left.any():
                break
            mask = np.where(left == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(words[first + k] & mask)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places, each from 0 to n - 1."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bits(level, at), self._ones(level, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last, each putting its zeros and ones back in their places."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            low, high, out = 0, self.zeros[level], np.empty(self.n, kind)
            value = kind(1 << (self.levels - 1 - level))
            for k in range(0, self.n, AT_ONCE):
                part, ones = out[k : k + AT_ONCE], np.flatnonzero(bit[k : k + AT_ONCE])
                zeros = np.flatnonzero(~bit[k : k + AT_ONCE])
                part[ones] = row[high : high + len(ones)] | value
                part[zeros] = row[low : low + len(zeros)]
                low, high = low + len(zeros), high + len(ones)
            row = out
        return row

    def rank(self, token: int, before: int | None = None) -> int:
        """Occurrences of an id before a place, by default in all."""
        low, high = self._range(token, self.n if before is None else before)
        return high - low

    def select(self, token: int, ks: np.ndarray) -> np.ndarray:
        """The places of the k-th occurrences of an id, counted from 0."""
        low, high = self._range(token, self.n)
        at = low + np.asarray(ks, np.int64)
        if len(at) and (at.min() < low or at.max() >= high):
            raise IndexError("no such occurrence")
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        return self.select(token, np.arange(self.rank(token)))

    def _range(self, token: int, before: int) -> tuple[int, int]:
        if token < 0 or token >> self.levels:
            return 0, 0
        ends = np.array([0, before], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, ends)
            ends = zeros + ones if token >> (self.levels - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def _nth(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th bits of a kind in a plane: the directory finds the block, halving the place."""
        ranks = self.ranks[level].astype(np.int64)
        counts = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        low = (np.searchsorted(counts, k, "right") - 1) * BLOCK
        high = np.minimum(low + BLOCK, self.n)
        while True:
            open_ = high - low > 1
            if not open_.any():
                return low
            middle = (low + high) // 2
            ones = self._ones(level, middle)
            before = (ones if bit else middle - ones) <= k
            low = np.where(open_ & before, middle, low)
            high = np.where(open_ & ~before, middle, high)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Unsafe(Exception):
    """A blank at which a text can't be cut."""


class _Memo(dict):
    """Ids of the first so many short pieces, among which the frequent ones are."""

    def kept(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= SHORT and len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class _Parts(_Memo):
    """Ids of pieces that CUT leaves; those of letters alone come from the model, as they are one part."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"

    def word(self, letters: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if ONE.match(piece):
            return self.kept(piece, self.word(piece.encode().decode("latin-1").translate(self.letters)))
        return self.kept(piece, array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes())


class _Blanks(_Memo):
    """Ids of what stands between blanks, with the blank before it."""

    def __init__(self, parts: _Parts) -> None:
        super().__init__()
        self.parts, self.blank = parts, parts.letters[32]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self.kept(piece, self.parts.word(self.blank + piece))
        if not (FIRST.match(piece) and LAST.search(piece)):
            raise Unsafe
        first, *rest = CUT.split(" " + piece)
        word = first[1:]
        head = self[word] if word.isascii() and word.isalpha() else self.parts[first]
        return self.kept(piece, b"".join([head, *map(self.parts.__getitem__, rest)]))


class Encoder:
    """Ids of whole texts, by the tokenizers library, for byte-level tokenizers that keep their usual pre-tokenizer.

    That pre-tokenizer always starts a new part at a blank between two other characters, at ASCII
    white space after another character, and where letters end. Texts are cut there, so the ids of
    the pieces, joined, are those of the whole; the library encodes each piece that isn't
    remembered. The first so many short pieces are, which holds the frequent ones. A text that holds
    one of the tokenizer's added tokens is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        self.parts = _Parts(path)
        self.blanks = _Blanks(self.parts)
        self.tokenizer = self.parts.tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(np.uint16 if self.parts.kind == "H" else np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        first, *rest = text.split(" ")
        try:
            if rest and not LAST.search(first):
                raise Unsafe
            found = [*map(self.parts.__getitem__, CUT.split(first)), *map(self.blanks.__getitem__, rest)]
        except Unsafe:
            found = map(self.parts.__getitem__, CUT.split(text))
        return np.frombuffer(b"".join(found), self.kind)


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, which Spark reuses for later tasks: what one task remembers serves the next."""
    kept = sys.__dict__.setdefault("_tidewatch_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _schema(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("keys", T.ArrayType(key)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("zeros", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.BinaryType())), T.StructField("ranks", T.ArrayType(T.BinaryType())),
    ])


def write_shards(
    docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS, range_bytes: int = RANGE_BYTES
) -> None:
    """Encode every whole text and write the ids, in ascending order of key, as files of shards.

    Null keys come first; rows of one key are ordered by a hash of their text, and rows alike in both
    are the same whatever their order, so they may fall into several ranges. A null text is an empty
    one and has the end id only. An empty table gives no shards. Only the key and the text are read.
    path is the tokenizer's file, found under the same path by every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = max(1, (max(end, vocabulary_size(path) - 1)).bit_length())
    schema = _schema(rows.schema["key"].dataType)
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(max(1, -(-size // range_bytes)), "key", "hash", "row").sortWithinPartitions("key", "hash", "row")
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("part"), "key", "text")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        keys, ids, piece, held, part = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            matrix = WaveletMatrix.of(np.concatenate(ids), levels)
            row = [part, piece, matrix.n, pa.concat_arrays(keys), [len(x) for x in ids], matrix.zeros, [p.tobytes() for p in matrix.planes], [r.tobytes() for r in matrix.ranks]]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if isinstance(x, pa.Array) else pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            begin = 0
            for i, text_ in enumerate(batch.column(2), 1):
                ids.append(np.append(own.encode(text_.as_py()), own.kind.type(end)))
                held += len(ids[-1])
                if held >= shard_tokens or i == batch.num_rows:
                    keys.append(batch.column(1).slice(begin, i - begin))
                    begin = i
                if held >= shard_tokens:
                    yield closed()
                    keys, ids, piece, held = [], [], piece + 1, 0
        if ids:
            yield closed()

    shards = ranged.mapInArrow(run, schema)
    shards.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(folder)


def shards(spark: SparkSession, folder: str, key: T.DataType | None = None) -> DataFrame:
    """One row per shard file, with its whole matrix."""
    return spark.read.schema(_schema(key or T.LongType())).parquet(folder)


def _matrix(batch: pa.RecordBatch, i: int) -> WaveletMatrix:
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
    return WaveletMatrix(get("n_tokens"), get("zeros"), get("planes"), get("ranks"))


def _begin(files: DataFrame) -> DataFrame:
    """(part, piece, begin): the ids before each shard, from the files' counts alone."""
    from pyspark.sql import Window as W

    sizes = files.select("part", "piece", "n_tokens")
    parts = offsets(sizes.groupBy("part").agg(F.sum("n_tokens").alias("before")), "part", ["before"])
    within = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("in_part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "piece", (F.col("before") + F.col("in_part")).alias("begin"))


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document from the shards' rows, and its ids if asked for.

    start counts the ids of all documents before it; the checksum is that of the ids as
    little-endian unsigned 32-bit integers.
    """
    element = files.schema["keys"].dataType.elementType
    fields = [T.StructField("part", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("key", element), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column(batch.schema.get_field_index("lengths"))[i].values.to_numpy()
                keys = batch.column(batch.schema.get_field_index("keys"))[i].values
                ends, crc = np.cumsum(lengths), np.zeros(len(lengths), np.int64)
                ids, n = _matrix(batch, i).ids(), len(lengths)
                for doc, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                    crc[doc] = zlib.crc32(ids[a:b].astype("<u4"))
                known = [pa.array(np.full(n, batch.column(j)[i].as_py(), np.int64)) for j in range(2)]
                made = [*known, keys, pa.array(ends - lengths), pa.array(lengths), pa.array(crc)]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                out = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, arrow, strict=True)], schema=arrow)
                yield from (out.slice(k, 10_000) for k in range(0, n, 10_000))

    columns = ["key", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return files.mapInArrow(run, schema).join(_begin(files), ["part", "piece"]).select(*columns)


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences in all shards, by rank; nothing is decoded."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = _matrix(batch, i)
                yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([matrix.rank(t) for t in wanted], pa.int64())})

    return files.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(place): every place of an id in the whole sequence, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = _matrix(batch, i)
                n = matrix.rank(token)
                for k in range(0, n, DECODED):
                    found = matrix.select(token, np.arange(k, min(n, k + DECODED)))
                    part, piece = (np.full(len(found), batch.column(j)[i].as_py(), np.int64) for j in range(2))
                    yield pa.RecordBatch.from_pydict({"part": part, "piece": piece, "at": found})

    found = files.mapInArrow(run, "part long, piece long, at long")
    return found.join(_begin(files), ["part", "piece"]).select((F.col("begin") + F.col("at")).alias("place"))


def op11_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes the shard files and reads every document back from them."""
    import uuid

    folder = f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_documents(shards(spark, folder)).withColumnRenamed("key", "doc_id")
