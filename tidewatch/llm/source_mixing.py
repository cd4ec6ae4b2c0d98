"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The budget is cut into blocks of the same number of tokens. Sources get blocks by highest
quotients target / (2k - 1); the blocks of a source go the same way to its shards, by their size.
Each shard lays its documents, in a seeded order, end to end as one stream of tokens and takes its
quota of that stream's blocks, evenly from a seeded start. A document's share is the overlap of its
tokens with the blocks taken, so no text is moved to decide on it.

A source has at most ``max_shards`` shards, and about ``shard_tokens`` tokens in each below that, so
a source with a third of all rows is spread over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, table, words
from tidewatch.operators.components import stored

BLOCK_TOKENS = 8
SHARD_TOKENS = 1 << 18
MAX_SHARDS = 4096
MAX_REPEATS = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    """A long from the first 12 hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, budget: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Append target to a table with one row per source: source_size, weight.

    The budget (all sizes where not given) is shared by weight; targets stop at max_repeats times
    their source's size and the excess is reshared by weight until none is above. Sources are
    taken by falling room per weight, so one pass of running sums finds the sources that stop.
    The table has one row per source; its numbers, not its documents, meet in one window.
    """
    cap = F.when(F.col("weight") > 0, F.col("source_size") * max_repeats).otherwise(0)
    room = F.try_divide(cap, F.col("weight")).asc_nulls_last()
    by_room = W.orderBy(room, "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) if budget is None else budget
    rows = sources.withColumn("cap", cap).withColumn("total", total)
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_room), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0)))
    # Sources before this one stop; this one does not if its room reaches its share of what they leave.
    open_here = F.col("cap").cast("double") >= F.try_divide(F.col("left").cast("double") * F.col("weight"), F.col("rest"))
    rows = rows.withColumn("at", F.when(open_here & (F.col("weight") > 0), F.struct(F.row_number().over(W.orderBy(room, "rank")).alias("n"), "left", "rest")))
    rows = rows.withColumn("level", F.min("at").over(everything))
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.rest")
    # A source that weighs nothing has no room and no target.
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share))
    return rows.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).drop("cap", "total", "left", "rest", "at", "level")


def apportion(rows: DataFrame, key: list[str], within: list[str], ideal: Column, seats: Column, most: Column) -> DataFrame:
    """Append quota: the seats of a group given by highest quotients ideal / (2k - 1), none above most.

    rows is a stored table with one row per key, which holds no null; within names the columns of
    a group, and the ideals of a group sum to about its seats. Equal quotients go by key. With S
    rows, the rounded ideals miss the seats by at most S/2, so a row is sure of all but its last
    few seats and only the quotients near the last winning one are ranked, however many seats
    there are.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    rows = rows.withColumns({"_ideal": ideal.cast("double"), "_seats": seats.cast("long"), "_most": most.cast("long")})
    rows = rows.withColumns({"_sum": F.sum("_ideal").over(group), "_rows": F.count("*").over(group)})
    each = F.when(F.col("_sum") > 0, F.col("_ideal") / F.col("_sum")).otherwise(0.0)
    low = F.floor(each * (F.col("_seats") - F.col("_rows"))) - 1
    high = F.ceil(each * (F.col("_seats") + F.col("_rows"))) + 1
    rows = rows.withColumn("_sure", F.least(F.greatest(low, F.lit(0)), "_most").cast("long"))
    rows = rows.withColumn("_last", F.when(F.col("_ideal") > 0, F.least(high, "_most")).otherwise(F.col("_sure")).cast("long"))
    rows = rows.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    bids = rows.where("_last > _sure").select(*key, "_open", "_ideal", F.explode(F.sequence(F.col("_sure") + 1, "_last")).alias("_k"))
    order = group.orderBy(F.desc(F.col("_ideal") / (2 * F.col("_k") - 1)), *key, "_k")
    won = bids.withColumn("_place", F.row_number().over(order)).where("_place <= _open").groupBy(*key).agg(F.count("*").alias("_won"))
    out = rows.join(won, key, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def mix_plan(
    docs: DataFrame,
    weights: DataFrame | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target and what the mix takes of it.

    weights has columns (source, weight); a source that it lacks weighs 0. Without it, sources by
    code point, null last, weigh 1, 2, 3, repeating. taken counts words, repeats included; start,
    blocks, quota and phase say which blocks of the shard's stream these are (see ``mix_texts``).
    The null source is a source. A null or empty text has size 0 and is never taken; a source
    without words has target 0. Repeated rows each have a place of their own in the stream, as
    many as there are; rows with a null key are laid out like others. No rows: no rows.
    """
    number = _number(_digest(F.col(f"`{key}`")))
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), number.alias("number"))
    slim = stored(slim, "sizes")
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1)
    if weights is None:
        sources = sources.withColumn("weight", F.lit(1) + F.col("rank") % 3)
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").alias("_w"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("weight", F.coalesce("_w", F.lit(0))).drop("_s", "_w")
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))).cast("long")
    sources = stored(targets(sources, max_repeats=max_repeats).withColumn("n_shards", shards), "sources")
    named = slim.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    named = named.withColumn("shard", F.col("number") % F.col("n_shards"))

    sizes = stored(named.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long"))
    room = sizes.groupBy("rank").agg((max_repeats * F.sum("blocks")).alias("room"))
    seats = F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block)
    by_source = stored(sources.join(room, "rank"), "rooms")
    by_source = apportion(by_source, ["rank"], [], F.col("target") / block, seats, F.col("room"))
    by_shard = stored(sizes.join(by_source.select("rank", "source_size", F.col("quota").alias("source_quota")), "rank"), "quotas")
    part = F.when(F.col("source_size") > 0, F.col("source_quota") * (F.col("shard_size") / F.col("source_size"))).otherwise(0.0)
    by_shard = apportion(by_shard, ["rank", "shard"], ["rank"], part, F.col("source_quota"), max_repeats * F.col("blocks"))
    phase = F.when(F.col("blocks") > 0, _number(_digest(F.col("rank"), F.col("shard"))) % F.col("blocks")).otherwise(0)
    by_shard = by_shard.select("rank", "shard", "blocks", "quota", phase.alias("phase"))

    stream = W.partitionBy("rank", "shard").orderBy("number", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = named.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(by_shard, ["rank", "shard"])
    rows = rows.withColumns({"j0": F.expr(f"start div {block}"), "j1": F.expr(f"(start + size - 1) div {block}")})
    upto = lambda j: F.expr(f"(({j}) * quota + phase) div blocks")  # noqa: E731  blocks taken before block j
    one = (F.col("size") * (upto("j0 + 1") - upto("j0"))).cast("long")
    head = ((F.col("j0") + 1) * block - F.col("start")) * (upto("j0 + 1") - upto("j0"))
    tail = (F.col("start") + F.col("size") - F.col("j1") * block) * (upto("j1 + 1") - upto("j1"))
    many = head + block * (upto("j1") - upto("j0 + 1")) + tail
    taken = F.when(F.col("size") == 0, 0).when(F.col("j0") == F.col("j1"), one).otherwise(many).cast("long")
    return rows.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"), "rank", "shard", "start", "blocks", "quota", "phase"
    )


def mix_texts(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of text that a plan takes: key, first_word, n_words, copies and the piece.

    Rows are runs of blocks of one document taken equally often; keys must be unique.
    """
    found = plan.where("taken > 0").select(key, "size", "start", "blocks", "quota", "phase")
    j = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    runs = found.withColumn("j", j).withColumn("copies", F.expr("((j + 1) * quota + phase) div blocks - (j * quota + phase) div blocks"))
    runs = runs.withColumns({"a": F.greatest(F.expr(f"j * {block} - start"), F.lit(0)), "b": F.least(F.expr(f"(j + 1) * {block} - start"), "size")})
    at = W.partitionBy(key).orderBy("j")
    runs = runs.withColumn("run", F.sum(F.when(F.lag("copies").over(at) == F.col("copies"), 0).otherwise(1)).over(at))
    spans = runs.where("copies > 0").groupBy(key, "run", "copies").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    texts = docs.select(F.col(f"`{key}`").alias(key), words(F.col(f"`{text}`")).alias("_w"))
    piece = F.array_join(F.slice("_w", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")), " ")
    return spans.join(texts, key).select(key, F.col("a").alias("first_word"), (F.col("b") - F.col("a")).alias("n_words"), "copies", piece.alias("text"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix: key, source, sizes, target and the words taken of each, over 0."""
    return mix_plan(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS BIGINT) AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS number
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), fill AS (
  -- Round by round, what the sources that stop leave goes to the others by weight.
  SELECT 0 AS n, rank, weight, cap, total, false AS stopped, total AS rest, CAST(sum(weight) OVER () AS BIGINT) AS open FROM w
  UNION ALL
  SELECT n + 1, rank, weight, cap, total, stopped,
    CAST(total - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0) AS BIGINT),
    CAST(coalesce(sum(CASE WHEN NOT stopped THEN weight END) OVER (), 0) AS BIGINT)
  FROM (SELECT n, rank, weight, cap, total, stopped OR (open > 0 AND cap < rest::DOUBLE * weight / open) AS stopped FROM fill WHERE n < 40)
), t AS (
  SELECT w.source, w.source_size, w.rank, w.total,
    CASE WHEN stopped OR open = 0 THEN w.cap::DOUBLE ELSE least(w.cap::DOUBLE, rest::DOUBLE * w.weight / open) END AS target,
    greatest(1, least(4096, ceil(w.source_size / 262144.0)))::BIGINT AS n_shards
  FROM w JOIN fill ON w.rank = fill.rank AND n = 40
), e AS (
  SELECT d.*, t.rank, t.source_size, t.target, t.total, number % n_shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), h AS (
  SELECT rank, shard, any_value(source_size) AS source_size, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / 8.0) AS BIGINT) AS blocks
  FROM e GROUP BY rank, shard
), b AS (
  SELECT rank, unnest(range(1, 3 * (SELECT CAST(sum(blocks) AS BIGINT) FROM h WHERE h.rank = t.rank) + 1)) AS k, target / 8 AS ideal, total FROM t
), q AS (
  SELECT rank, count(*) AS source_quota
  FROM (SELECT *, row_number() OVER (ORDER BY ideal / (2 * k - 1) DESC, rank, k) AS place FROM b WHERE ideal > 0)
  WHERE place <= round(total / 8.0) GROUP BY rank
), hq AS (
  SELECT h.*, source_quota, unnest(range(1, 3 * blocks + 1)) AS k FROM h JOIN q ON h.rank = q.rank
), z AS (
  SELECT rank, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY source_quota * (shard_size / source_size) / (2 * k - 1) DESC, shard, k) AS place FROM hq)
  WHERE place <= source_quota GROUP BY rank, shard
), f AS (
  SELECT e.*, h.blocks, coalesce(z.quota, 0) AS quota,
    CASE WHEN h.blocks > 0 THEN ('0x' || substr(md5('mix-1:' || e.rank || ':' || e.shard), 1, 12))::BIGINT % h.blocks ELSE 0 END AS phase,
    CAST(coalesce(sum(size) OVER (PARTITION BY e.rank, e.shard ORDER BY number, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM e JOIN h ON e.rank = h.rank AND e.shard = h.shard LEFT JOIN z ON e.rank = z.rank AND e.shard = z.shard
), g AS (
  -- Word by block: the document's overlap with each block, times how often the block is taken.
  SELECT doc_id, source, size, source_size, target, start, blocks, quota, phase, unnest(CASE WHEN size > 0 THEN range(start // 8, (start + size - 1) // 8 + 1) ELSE [NULL] END) AS j,
    row_number() OVER () AS r
  FROM f
)
SELECT doc_id, size, source_size, target, source,
  CAST(coalesce(sum((least(start + size, 8 * (j + 1)) - greatest(start, 8 * j)) * (((j + 1) * quota + phase) // blocks - (j * quota + phase) // blocks)), 0) AS BIGINT) AS taken
FROM g GROUP BY r, doc_id, size, source_size, target, source
"""
