"""Katz back-off language models over word n-grams, and the scores of texts under them.

Texts are cut into blocks of whole documents with word numbers of their own. For each order, a block
sends its distinct n-grams, as sorted 64-bit hashes with their training counts, to the buckets that
own those hashes; a bucket adds the counts up and answers each block in the order it asked. So one
exchange both counts the training n-grams of an order over the whole corpus and gives every block
the totals it scores with; its size follows the distinct n-grams of blocks, a frequent n-gram costs
no more than a rare one, and buckets grow in number with the corpus. Answers are written as tables
partitioned by order.

Counts up to K are discounted by Good-Turing. What the seen words after a history give up is its
back-off weight's share: alpha(h) = (1 - sum of discounted p(w|h)) / (1 - sum of lower p(w|h'))
over the words seen after h, so the probabilities after every history, of all known words and the
one unknown word, add up to one. These sums are exchanged like counts, each distinct n-gram being
added once, by the first block that holds it. A token is then scored recursively from order 1 up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from tidewatch.llm.common import id_hash, table
from tidewatch.operators.components import stored

ORDER = 2
#: Counts up to which Good-Turing discounts; higher ones are taken as they are.
K = 5
#: Tokens after which a block ends, and distinct n-grams that a bucket is meant to hold, up to BASE_BYTES of text.
#: Beyond, both grow with the square root of the text, so the messages between them, blocks times
#: buckets, grow with the text itself and hold 100 n-grams and more.
BLOCK_TOKENS = 1_000_000
BUCKET_GRAMS = 2_000_000
BASE_BYTES = 100 << 30
#: Words numbered first in every block; they hold a blank, which no word does.
MARKS = (b" end", b" begin")
END, BEGIN = 0, 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCK = [T.StructField("block", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("ids", "lengths", "train", "vocabulary")]]


def encoded(docs: DataFrame, key: str, text: str, train: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of documents: their keys, word numbers, lengths, training flags and the hashes of the block's words.

    A-Z are lower-cased; tokens are runs without ASCII white space, then one end. A null text is empty.
    """
    kind = docs.schema[key].dataType
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"), train.alias("train"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, made = to_arrow_schema(schema), TaskContext.get().partitionId(), 0

        def fresh() -> tuple[dict[bytes, int], list, list, list, int]:
            return {m: i for i, m in enumerate(MARKS)}, [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes = np.array([xxh64_intdigest(w) for w in number], np.uint64)
            row = [[keys], [(part << 32) + made], [pack(np.concatenate(ids))], [pack(np.array([len(x) for x in ids], np.int32))], [pack(np.array(flags, np.uint8))], [hashes.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

        number, keys, ids, flags, n = fresh()
        for batch in batches:
            for key, text, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = (text or b"").lower().split()
                own = np.zeros(len(found) + 1, np.int32)
                own[:-1] = [number.setdefault(w, len(number)) for w in found]
                keys.append(key), ids.append(own), flags.append(bool(flag))
                n += len(own)
                if n >= block_tokens:
                    yield block()
                    made += 1
                    number, keys, ids, flags, n = fresh()
        if keys:
            yield block()

    return slim.mapInArrow(run, schema)


@dataclass
class Tokens:
    """A block's tokens in order: hashes, place in their document, and whether they train."""

    hashes: np.ndarray
    place: np.ndarray
    train: np.ndarray
    lengths: np.ndarray
    begin: np.uint64

    @classmethod
    def read(cls, row: dict) -> Tokens:
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        ids, lengths = unpack(row["ids"], np.int32), unpack(row["lengths"], np.int32).astype(np.int64)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return cls(vocabulary[ids], place, np.repeat(unpack(row["train"], np.uint8).astype(bool), lengths), lengths, vocabulary[BEGIN])

    def back(self, k: int) -> np.ndarray:
        """The hashes of the tokens k places before, a begin where the document has none."""
        if not k:
            return self.hashes
        out = np.empty_like(self.hashes)
        out[:k] = self.begin
        out[k:] = self.hashes[:-k]
        out[self.place < k] = self.begin
        return out

    def grams(self, order: int, skip: int = 0) -> np.ndarray:
        """A hash of the order tokens that end skip places before each token."""
        out = np.full(len(self.hashes), np.uint64(order))
        for k in range(order - 1, -1, -1):
            out = _mixed(out * _MULTIPLIER + self.back(k + skip))
        return out


def _slices(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Runs of sorted keys with the same leading bits."""
    if not bits:
        return [(0, slice(0, len(keys)))] if len(keys) else []
    heads = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(heads, prepend=-1))
    return [(int(heads[a]), slice(int(a), int(b))) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]


ASK = "bucket int, block long, keys binary, n0 binary, n1 binary, n2 binary"


def _asking(tables: Iterator[tuple[int, np.ndarray, list[np.ndarray]]], bits: int) -> Iterator[pa.RecordBatch]:
    for block, keys, sums in tables:
        rows = []
        for bucket, own in _slices(keys, bits):
            rows.append([bucket, block, pack_sorted(keys[own]), *(pack(s[own]) for s in sums), *[None] * (3 - len(sums))])
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "block", "keys", "n0", "n1", "n2"])


def ask_counts(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """Each block's distinct n-grams of an order with their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
            for batch in batches:
                for row in batch.to_pylist():
                    tokens = Tokens.read(row)
                    keys, at = np.unique(tokens.grams(order), return_inverse=True)
                    yield row["block"], keys, [np.bincount(at[tokens.train], minlength=len(keys)).astype(np.uint32)]

        yield from _asking(tables(), bits)

    return blocks.select("block", "ids", "lengths", "train", "vocabulary").mapInArrow(run, ASK)


ANSWER = "kind int, order int, bucket int, block long, s0 binary, s1 binary, first binary, stats array<long>"
COUNTS, WEIGHTS = 0, 1


def answered(asked: DataFrame, kind: int, order: int) -> DataFrame:
    """Add up what blocks ask under each hash and answer in their order: totals, or a history's denominator and weight.

    first marks, among the blocks with an n-gram of the training texts, the one that counts it. A
    row with block -1 has the bucket's number of n-grams, of tokens, and of n-grams seen once, twice and so on.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        number = np.uint32 if kind == COUNTS else np.float64
        sums = []
        for name in ("n0", "n1", "n2")[: 1 if kind == COUNTS else 3]:
            given = np.concatenate([unpack(r[name], number) for r in rows])
            sums.append(np.bincount(at, given, len(first)))
        owns = np.zeros(len(at), bool)
        owns[first] = True
        if kind == COUNTS:
            values = [sums[0].astype(np.uint64)]
        else:
            total, kept, lower = sums
            size = total + ((total > 0) & (total - kept <= 1e-9 * total))  # a history whose counts give nothing up
            values = [size.astype(np.uint64), (1 - kept / np.maximum(size, 1)) / np.maximum(1 - lower, 1e-12)]
        out = []
        for r, end, k in zip(rows, ends, keys, strict=True):
            own = slice(end - len(k), end)
            mark = pack(np.packbits(owns[own])) if kind == COUNTS else None
            out.append([kind, order, r["bucket"], r["block"], *(pack(v[at[own]]) for v in values), *[None] * (2 - len(values)), mark, None])
        if kind == COUNTS:
            seen = sums[0][sums[0] > 0].astype(np.int64)
            stats = [len(seen), int(seen.sum()), *np.bincount(seen[seen <= K + 1], minlength=K + 2)[1:].tolist()]
            out.append([kind, order, rows[0]["bucket"], -1, None, None, None, stats])
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]
        names = [c.split()[0] for c in ANSWER.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return stored(asked.groupBy("bucket").applyInArrow(run, ANSWER), f"katz-{('counts', 'weights')[kind]}", ["order"])


def sizes(n_bytes: int) -> tuple[int, int]:
    """Tokens of a block and n-grams of a bucket for so many bytes of text."""
    factor = max(1.0, n_bytes / BASE_BYTES) ** 0.5
    return int(BLOCK_TOKENS * factor), int(BUCKET_GRAMS * factor)


def good_turing(counts: list[int]) -> list[float]:
    """Discount factors for counts 1 to K from the numbers of n-grams seen 1 to K+1 times.

    The largest cutoff up to K at which every factor lies in (0, 1] is taken; where none does, as
    in tiny corpora, half a count is taken off each count up to K.
    """
    n = [0, *counts]
    for top in range(min(K, len(counts) - 1), 0, -1):
        if not all(n[r] > 0 for r in range(1, top + 2)):
            continue
        spare = (top + 1) * n[top + 1] / n[1]
        if spare >= 1:
            continue
        factors = [((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) for r in range(1, top + 1)]
        if all(0 < d <= 1 for d in factors) and factors[0] < 1:
            return factors + [1.0] * (K - top)
    return [1 - 0.5 / r for r in range(1, K + 1)]


@dataclass
class Model:
    """What is known of the whole corpus: sizes and the discounts of each order."""

    order: int
    tokens: int = 0
    types: int = 0
    unknown: float = 1.0
    total: float = 1.0
    discounts: dict[int, list[float]] = field(default_factory=dict)

    def learn(self, order: int, stats: list[int]) -> None:
        self.discounts[order] = good_turing(stats[2:])
        if order == 1:
            self.types, self.tokens = stats[0], stats[1]
            given_up = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(self.discounts[1], stats[2:], strict=False), 1))
            self.total = self.tokens + (given_up <= 0)
            self.unknown = 1 - (self.tokens - given_up) / self.total if self.tokens else 1.0

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Counts times their discount factors."""
        factors = np.array([0.0, *self.discounts[order], 1.0])
        return counts * factors[np.minimum(counts, K + 1).astype(np.int64)]


class _Answers:
    """The answers that a block got, joined in the order of its keys."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows: dict[tuple[int, int], list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["bucket"]):
            self.rows.setdefault((r["kind"], r["order"]), []).append(r)

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [(unpack(r["s0"], np.uint64).astype(np.int64), unpack(r["first"], np.uint8)) for r in self.rows[COUNTS, order]]
        return np.concatenate([c for c, _ in rows]), np.concatenate([np.unpackbits(f)[: len(c)].astype(bool) for c, f in rows])

    def weights(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The denominator of each history, 0 for one that training lacks, and its back-off weight."""
        rows = [(unpack(r["s0"], np.uint64), unpack(r["s1"], np.float64)) for r in self.rows[WEIGHTS, order]]
        return np.concatenate([s for s, _ in rows]).astype(np.float64), np.concatenate([w for _, w in rows])


def _log_probabilities(tokens: Tokens, answers: _Answers, model: Model, order: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each token up to an order, and the training counts of the tokens."""
    known = counts = None
    for k in range(1, order + 1):
        keys, at = np.unique(tokens.grams(k), return_inverse=True)
        seen = answers.counts(k)[0][at]
        if k == 1:
            counts = seen
            known = np.log10(np.where(seen > 0, model.discounted(1, seen) / model.total, model.unknown))
            continue
        _, where = np.unique(tokens.grams(k - 1, skip=1), return_inverse=True)
        size, weight = (w[where] for w in answers.weights(k))
        backed = known + np.log10(np.where(size > 0, weight, 1.0))
        known = np.where(seen > 0, np.log10(np.maximum(model.discounted(k, seen), 1e-300) / np.maximum(size, 1)), backed)
    return known, counts


def ask_weights(blocks: DataFrame, answers: DataFrame, model: Model, order: int, bits: int) -> DataFrame:
    """For each history of an order's n-grams: the sums over the words seen after it, of what a block counts.

    The sums are of the counts, of the discounted counts, and of the words' probabilities one order down.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def tables() -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
            found = _Answers(right.to_pylist())
            for row in left.to_pylist():
                tokens = Tokens.read(row)
                lower, _ = _log_probabilities(tokens, found, model, order - 1)
                _, at = np.unique(tokens.grams(order), return_index=True)
                seen, first = found.counts(order)
                own = first & (seen > 0)
                keys, where = np.unique(tokens.grams(order - 1, skip=1), return_inverse=True)
                where, seen, p = where[at[own]], seen[own], 10.0 ** lower[at[own]]
                yield row["block"], keys, [np.bincount(where, v, len(keys)) for v in (seen, model.discounted(order, seen), p)]

        return pa.Table.from_batches(list(_asking(tables(), bits)))

    return _with_answers(blocks, answers).applyInArrow(run, ASK)


def _with_answers(blocks: DataFrame, answers: DataFrame):
    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))


def scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int | None = None, bucket_grams: int | None = None) -> DataFrame:
    """Learn a model of an order from the rows where train holds, and score every row.

    Returns key, train, n_tokens, n_known (training knows the token), train_tokens, base_score (the
    sum of log10 of unigram probabilities with 0.1 added to each count) and score (log10 of the
    text's probability under the model). The end counts as a token, so an empty or null text is
    one token. N-grams are told apart by 64-bit hashes: of N distinct ones about N * N / 2 ** 65 pairs
    share a hash and add their counts up, none to be expected below some billions, one n-gram in 4e7
    at 1e12. Words that training lacks are one unknown word; histories that it lacks back off
    without a weight. A null flag doesn't train; without training rows every token is unknown,
    with probability one. Repeated rows are scored, and learnt from, as often as they occur.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    if block_tokens is None or bucket_grams is None:
        block, bucket = sizes(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("binary")))).first()[0] or 0)
        block_tokens, bucket_grams = block_tokens or block, bucket_grams or bucket
    blocks = stored(encoded(docs, key, text, F.coalesce(train, F.lit(False)), block_tokens), "katz-blocks")
    n = blocks.agg(F.sum(F.octet_length("vocabulary")).alias("v"), F.count("*").alias("b")).first()
    bits_for = lambda grams: (grams // bucket_grams).bit_length()
    word_bits, gram_bits = bits_for((n.v or 0) // 8), bits_for(n.b * block_tokens)
    model, answers = Model(order), None
    for k in range(1, order + 1):
        counts = answered(ask_counts(blocks, k, word_bits if k == 1 else gram_bits), COUNTS, k)
        sums = counts.where("block = -1").agg(*[F.sum(F.col("stats")[i]) for i in range(K + 3)]).first()
        model.learn(k, [int(x or 0) for x in sums])
        answers = counts if answers is None else answers.unionByName(counts)
        if k > 1:
            asked = ask_weights(blocks, answers, model, k, word_bits if k == 2 else gram_bits)
            answers = answers.unionByName(answered(asked, WEIGHTS, k))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, parts = _Answers(right.to_pylist()), []
        for row in left.drop_columns(["keys"]).to_pylist():
            tokens = Tokens.read(row)
            logs, seen = _log_probabilities(tokens, found, model, order)
            base = np.log10((seen + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            starts = np.cumsum(tokens.lengths) - tokens.lengths
            add = lambda v: np.add.reduceat(v, starts)
            parts.append((unpack(row["train"], np.uint8).astype(bool), tokens.lengths, add((seen > 0).astype(np.int64)), add(base), add(logs)))
        train, lengths, known, base, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns = [left["keys"].combine_chunks().flatten(), train, lengths, known, np.full(len(lengths), model.tokens), base, logs]
        return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)

    kind = docs.schema[key].dataType
    fields = [("key", kind), ("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    names = [f for f, _ in fields]
    return _with_answers(blocks, answers).applyInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fold, token counts, the add-0.1 unigram score and the Katz score."""
    train = F.pmod(id_hash(F.col("doc_id")), F.lit(10)) != 0
    found = scores(table(spark, sf_dir, "documents"), train)
    return found.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
