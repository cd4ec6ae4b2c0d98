"""How the sources of each language differ in their terms.

Terms are cut from the UTF-8 bytes of many texts at once: a table of 256 entries lower-cases bytes
and blanks all that ends a term, and places where it turns are the terms' bounds. Slices are grouped
by XXH64 and every slice is compared, byte by byte, with the first of its group, so equal hashes of
different terms can't merge. Counts by language, source and term are summed by Spark. Kept terms are
dealt to blocks of their language; a block is a sparse matrix in CSR form, a row for each source, and
sums of divergences over a pair of rows come from np.add.reduceat over the row bounds. What a block
adds to a pair of sources is summed over blocks by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewatch.llm.common import table
from tidewatch.operators.components import stored

LEAST = 10
RANKS = 10
SCALE = 1_000_000_000
#: Bytes of text that are cut at a time, if no text is longer.
CHUNK = 8 << 20
#: Counts that a block of one language holds on average.
BLOCK_ROWS = 50_000
#: What each byte of a term becomes; 0 ends a term.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def slices(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and where terms start and end; no term crosses one of the bounds."""
    low = LOWER[data]
    inside = low != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return low, np.flatnonzero(begins), np.flatnonzero(ends) + 1


def same_bytes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each slice, whether its bytes are those of as many from another place; so many slices at a time."""
    out = np.empty(len(starts), bool)
    for k in range(0, len(starts), 1 << 16):
        n = lengths[k : k + (1 << 16)]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        alike = low[np.repeat(starts[k : k + len(n)], n) + inner] == low[np.repeat(others[k : k + len(n)], n) + inner]
        out[k : k + len(n)] = np.logical_and.reduceat(alike, begin)
    return out


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each slice the number of its term, and the terms."""
    data = low.tobytes()
    hashes = np.fromiter((xxh64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    lengths = ends - starts
    same = lengths == lengths[first][number]
    if same.all():
        same = same_bytes(low, starts, lengths, starts[first][number])
    if not same.all():  # two terms of one hash
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        terms = list(known)
    return number, terms


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the texts it is in.

    Nulls count as empty strings. Every (lang, source) also has a row without a term, so groups
    without terms are seen. Only the three columns are read.
    """
    some = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = docs.select(some(lang).alias("lang"), some(source).alias("source"), some(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(rows_schema)
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column(2)], np.int64)
            parts = np.cumsum(sizes) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                chunk = batch.slice(a, b - a)
                names: dict[tuple[str, str], int] = {}
                group = np.array([names.setdefault(k, len(names)) for k in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True)], np.int64)
                data = np.frombuffer(b"".join(x.as_buffer() for x in chunk.column(2)), np.uint8)
                bounds = np.append(0, np.cumsum(sizes[a:b]))
                keys = list(names)
                low, starts, ends = slices(data, bounds)
                number, terms = grouped(low, starts, ends)
                doc = np.searchsorted(bounds, starts, "right") - 1
                width = max(len(terms), 1)
                pair, n = np.unique(doc * width + number, return_counts=True)
                key, place = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, n)
                found = np.bincount(place, minlength=len(key)) if len(key) else np.zeros(0, np.int64)
                of = [keys[g] for g in (key // width).tolist()]
                columns = [[k[0] for k in keys + of], [k[1] for k in keys + of], [None] * len(keys) + [terms[t].decode() for t in (key % width).tolist()], [0] * len(keys) + total.tolist(), [0] * len(keys) + found.tolist()]
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                yield from (out.slice(k, 10_000) for k in range(0, out.num_rows, 10_000))

    from pyspark.sql.types import StructType

    rows_schema = StructType.fromDDL(COUNTS)
    return rows.mapInArrow(run, rows_schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    a, b = np.asarray(count) + 2, np.asarray(total) + 2 * kept
    if np.max(b, initial=0) < 1 << 47:
        high, rest = np.divmod(a * 31_250, b)
        return 1 + high * 32_000 + rest * 32_000 // b
    wide = SCALE * a.astype(object) // b.astype(object)
    return (1 + wide).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(bounds: np.ndarray, column: np.ndarray, p: np.ndarray, absent: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a CSR matrix its divergences from all later rows, summed over all columns.

    p holds the shares of the entries, absent each row's share where it has none. All columns are
    first taken as absent in the later row, then its own entries are put right.
    """
    row_of = np.repeat(np.arange(len(absent)), np.diff(bounds))
    for s in range(len(absent) - 1):
        later = absent[s + 1 :]
        mine = p[bounds[s] : bounds[s + 1]]
        out = (width - len(mine)) * divergence(absent[s], later)
        for k in range(0, len(mine), max(1, 1_000_000 // len(later))):
            out = out + divergence(mine[k : k + max(1, 1_000_000 // len(later)), None], later[None, :]).sum(axis=0)
        at = bounds[s + 1]
        dense = np.full(width, absent[s], np.int64)
        dense[column[bounds[s] : at]] = mine
        theirs = dense[column[at:]]
        mend = divergence(theirs, p[at:]) - divergence(theirs, absent[row_of[at:]])
        begins = bounds[s + 1 : -1] - at
        full = np.flatnonzero(np.diff(bounds[s + 1 :]))
        if len(full):
            out[full] += np.add.reduceat(mend, begins[full])
        yield s, out


def _block(lang: str, names: list[str], totals: np.ndarray, kept: int, source: list[str], term: list[bytes], n: np.ndarray, ranks: int) -> Iterator[tuple]:
    """(source, part, item, value) columns of one block; entries come sorted by source."""
    row = {s: i for i, s in enumerate(names)}
    bounds = np.append(0, np.cumsum(np.bincount([row[s] for s in source], minlength=len(names)))).astype(np.int64)
    terms, column = np.unique(np.array(term, object), return_inverse=True) if term else (np.array([], object), np.zeros(0, np.int64))
    column = column.astype(np.int64)
    if not kept:
        for s in range(len(names) - 1):
            yield [names[s]] * (len(names) - s - 1), "pair", names[s + 1 :], [0] * (len(names) - s - 1)
        return
    row_of = np.repeat(np.arange(len(names)), np.diff(bounds))
    p = share(n, totals[row_of], kept)
    for s, values in pair_sums(bounds, column, p, share(np.zeros(len(names), np.int64), totals, kept), len(terms)):
        yield [names[s]] * len(values), "pair", names[s + 1 :], values.tolist()
    all_ = np.zeros(len(terms), np.int64)
    np.add.at(all_, column, n)
    q = share(all_, np.full(len(terms), totals.sum()), kept)[column]
    for s in range(len(names)):
        at = np.arange(bounds[s], bounds[s + 1])
        at = at[p[at] > q[at]]
        value = divergence(p[at], q[at])
        best = np.lexsort((column[at], -value))[:ranks]
        yield [names[s]] * len(best), "term", [terms[c].decode() for c in column[at][best].tolist()], value[best].tolist()


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, ranks: int = RANKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from every other of its language, and by which terms.

    A language keeps the terms that at least ``least`` of its texts hold. Part "pair" has a row for
    each other source of the language, part "term" the kept terms that a source uses more than its
    language does, down to rank ``ranks``. Null language, source or text is the empty string; repeated
    rows count as often as they come; a group without terms, and a language without kept terms, has
    pairs of value 0 or of its absent shares; an empty table gives no rows. Only three columns are read.
    """
    counts = stored(term_counts(docs, lang, source, text), "terms")
    held = counts.where("term IS NOT NULL").withColumn("in", F.sum("docs").over(W.partitionBy("lang", "term"))).where(F.col("in") >= least)
    kept = stored(held.select("lang", "source", "term", "n"), "kept")
    width = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(width, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block_rows))
    none = F.lit(None)
    # Every block of a language needs its groups: a row for each, ahead of the block's entries.
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "source", none.cast("string").alias("term"), "n", "kept")
    entries = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "source", "term", "n", none.cast("long").alias("kept"))
    dealt = heads.unionByName(entries).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(parts_schema)

        def closed(lang_: str, held_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held_)
            kind = whole.column("kind").to_numpy()
            at = int((kind == 0).sum())
            n = whole.column("n").to_numpy().astype(np.int64)
            source_ = whole.column("source").to_pylist()
            term = whole.column("term").slice(at).cast(pa.binary()).to_pylist()
            for of, part, items, values in _block(lang_, source_[:at], n[:at], whole.column("kept")[0].as_py(), source_[at:], term, n[at:], ranks):
                columns = [[lang_] * len(of), of, [part] * len(of), items, values]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        key, held_ = None, []
        for batch in batches:
            langs, numbers = batch.column(0), batch.column(1).to_numpy()
            ids = langs.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                now = (langs[a].as_py(), int(numbers[a]))
                if held_ and now != key:
                    yield from closed(key[0], held_)
                    held_ = []
                key = now
                held_.append(batch.slice(a, b - a))
        if held_:
            yield from closed(key[0], held_)

    from pyspark.sql.types import StructType

    parts_schema = StructType.fromDDL(PARTS)
    found = stored(dealt.mapInArrow(run, parts_schema), "parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    pairs = sums.select("lang", ends, "part", "value").select("lang", "e.source", "part", "e.item", "value")
    along = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(along).alias("rank")
    top = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= ranks)
    return pairs.select("*", rank).unionByName(top)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence audit of all documents."""
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1::HUGEINT + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(t.total, 0) + 2 * v.v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT p.lang, p.term, 1::HUGEINT + (1000000000::HUGEINT * (sum(p.n) + 2)::HUGEINT) // (any_value(x.total) + 2 * any_value(v.v))::HUGEINT AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) x USING (lang) GROUP BY p.lang, p.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - l.q) * (p.p - l.q) // (p.p + l.q)
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_)
WHERE part = 'pair' OR rank <= 10
"""
